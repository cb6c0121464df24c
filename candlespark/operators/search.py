"""Configurations as data: grids, leaderboards, narrowing, sensitivity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlespark.functions.safe import div


def config_id(columns: Sequence[str]) -> Column:
    """Key of a configuration: the hash of its JSON form."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def param_grid(spark: SparkSession, grid: Mapping[str, Sequence]) -> DataFrame:
    """One row per combination.  The lists are literals, exploded in turn."""
    out = spark.range(1).select()
    for name, values in grid.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def grid_size(grid: Mapping[str, Sequence]) -> int:
    return sum(1 for _ in product(*grid.values()))


def alignment_table(preds: DataFrame, loss: Column, config: str = "config") -> DataFrame:
    """Mean loss and directional metric per configuration, and rank disagreement."""
    y, p = F.col("y_true"), F.col("y_pred")
    same = F.signum(y) == F.signum(p)
    per = preds.groupBy(config).agg(
        F.avg(loss).alias("mean_loss"),
        div(F.sum(F.when(same, F.abs(y)).otherwise(-F.abs(y))), F.sum(F.abs(y))).alias("czar_improvement"),
    )
    # One row per configuration from here on.
    one = Window.partitionBy(F.lit(0))
    per = per.withColumn("loss_rank", F.rank().over(one.orderBy(F.round("mean_loss", 9))).cast("long"))
    per = per.withColumn("metric_rank", F.rank().over(one.orderBy(F.round("czar_improvement", 9).desc())).cast("long"))
    return per.withColumn("disagree", F.col("loss_rank") != F.col("metric_rank"))


def leaderboard(reports: DataFrame, config: str, top: int | None = None) -> DataFrame:
    """Reports by passes, then score; the configuration breaks ties."""
    ordered = reports.orderBy(F.desc("num_passed"), F.desc("score"), config)
    return ordered if top is None else ordered.limit(top)


def best(reports: DataFrame, config: str) -> DataFrame:
    """The leading row, by one aggregate instead of a sort."""
    return leaderboard(reports, config, 1)


def narrow(results: DataFrame, score: str, params: Sequence[str], share: float = 0.2) -> DataFrame:
    """Range of each parameter among the best ``share`` of configurations."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(score))
    top = results.withColumn("_p", F.percent_rank().over(w)).where(F.col("_p") <= share)
    items = F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in params])
    long = top.select(F.explode(items).alias("i")).select("i.*")
    return long.groupBy("param").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))


def sensitivity(results: DataFrame, score: str, params: Mapping[str, Sequence[float]], config: str) -> DataFrame:
    """Worst score drop when one parameter moves one grid step.

    Neighbours come from an equi join per parameter on all other parameters
    and the step number, not from a cross product.
    """
    names = list(params)
    steps = results.select(
        config, score, *[F.array_position(F.array(*[F.lit(float(v)) for v in params[p]]), F.col(p).cast("double")).alias(p) for p in names]
    )
    drops = None
    for p in names:
        other = [q for q in names if q != p]
        near = steps.select(*other, F.col(score).alias("_near"), F.explode(F.array(F.col(p) - 1, F.col(p) + 1)).alias(p))
        pairs = steps.join(near, names).select(config, F.lit(p).alias("param"), (F.col(score) - F.col("_near")).alias("drop"))
        drops = pairs if drops is None else drops.unionByName(pairs)
    return drops.groupBy(config, "param").agg(F.max("drop").alias("worst_drop"), F.count(F.lit(1)).alias("n_neighbours"))
