"""Live scoring, live metrics and event sync as streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespark.operators.features import live_features, look_back_hours
from candlespark.sources.bars import scan_bars
from candlespark.sources.events import append_events
from candlespark.sources.versions import stream_of
from candlespark.streaming.bars import as_batch, upsert_bars


def scoring_batches(store: str, source: str, out: str, freq: str, n: int, score: Callable[[DataFrame], DataFrame]):
    """A ``foreachBatch`` function for live scoring.

    Each batch is merged into the store; the symbols it brought are scored on
    their newest windows, by the code that builds training features.  The scan
    reads the look-back that ``n`` bars of ``freq`` need, of those symbols and
    days only.  Symbols with too few bars for a window go to ``<out>-short``.
    Output goes to a folder per batch, so a repeated batch overwrites its own rows.
    """
    alone = uuid.uuid4().hex

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bars = as_batch(batch)
        upsert_bars(bars, store, source, writer=stream_of(batch, alone), batch=batch_id)
        newest = bars.agg(F.max("open_time").alias("t")).first()["t"]
        if newest is None:
            return
        # The newest minute has closed: messages of open candles were dropped.
        now = newest + timedelta(minutes=1)
        recent = scan_bars(spark, store, start=now - timedelta(hours=look_back_hours(freq, n)), source=source)
        recent = recent.join(bars.select("symbol").distinct(), "symbol", "left_semi")
        rows = live_features(recent, freq, n, F.lit(now).cast("timestamp_ntz"))
        usable = F.coalesce(F.col("enough") & F.col("window").isNotNull(), F.lit(False))
        score(rows.where(usable)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        rows.where(~usable).drop("window").write.mode("overwrite").parquet(f"{out}-short/batch={batch_id}")

    return run


def sync_batches(path: str):
    """A ``foreachBatch`` function that appends what the event store lacks.

    The store is the memory of what was seen, for ever: an event counts once
    however late it comes or is repeated, and no state grows in the stream.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        append_events(batch, path)

    return run


def live_accuracy(pairs: DataFrame, keys: Sequence[str], size: str, gate: float, time: str = "open_time") -> DataFrame:
    """Hit rate per closed window and whether it is below the gate."""
    moved = F.col("y_true") != 0
    hit: Column = moved & (F.signum("y_true") == F.signum("y_pred"))
    out = pairs.groupBy(*keys, F.window(time, size).alias("_w")).agg(F.count_if(moved).alias("n"), F.count_if(hit).alias("hits"))
    rate = F.try_divide(F.col("hits").cast("double"), F.col("n").cast("double"))
    return out.select(*keys, F.col("_w.start").alias("window_start"), "n", "hits", rate.alias("da"), F.coalesce(rate < gate, F.lit(False)).alias("trigger"))
