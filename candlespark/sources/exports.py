"""Sinks: predictions and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predictions(df: DataFrame) -> DataFrame:
    return df.where(F.col("pred").isNotNull()).select("open_time", "target", "pred")


def export_predictions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write (open_time, target, pred) of the rows that have a prediction."""
    writer = predictions(df).write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.parquet(path)


def run_records(runs: DataFrame, config: list[str], metrics: list[str]) -> DataFrame:
    """One JSON record per run: configuration and metrics."""
    return runs.select(F.to_json(F.struct(F.struct(*config).alias("config"), F.struct(*metrics).alias("metrics"))).alias("record"))


def export_runs(runs: DataFrame, config: list[str], metrics: list[str], path: str) -> None:
    run_records(runs, config, metrics).withColumnRenamed("record", "value").write.mode("overwrite").text(path)
