"""Structured Streaming over candle messages.

The streams share their code with the batch jobs: landing, resampling,
features and the upsert.  Event times are TIMESTAMP here, since watermarks
need it.  Every sink is idempotent, so a restart from the checkpoint repeats
at most the last batch.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespark.functions.times import interval_minutes, is_ntz
from candlespark.operators.resample import OHLCV_TRADES, resample
from candlespark.sources import snapshots as commits
from candlespark.sources.bars import reconcile_columns, scan_bars, touched, upsert_bars, with_layout
from candlespark.sources.payloads import land_stream_klines
from candlespark.sources.versions import stream_of


def messages_from_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Text files of JSON messages, one per line, as a stream."""
    reader = spark.readStream.schema("value STRING")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format("text").load(path)


def closed_bars(messages: DataFrame) -> DataFrame:
    """Closed candles, however late, with every corrected copy.

    No state and no watermark: the upsert keeps one row per candle, the latest,
    so nothing needs to be dropped here.  Aggregations add their own watermark.
    """
    return land_stream_klines(messages)


def stream_resample(bars: DataFrame, freq: str, time: str = "open_time") -> DataFrame:
    """Tumbling bars, emitted once their window is past the watermark.

    ``bars`` must carry a watermark.  Rows of one (symbol, time) are unique.
    """
    width = f"{interval_minutes(freq)} minutes"
    aggs = [
        F.min_by("open", time).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", time).alias("close"), F.sum("volume").alias("volume"), F.sum("n_trades").alias("n_trades"),
    ]
    out = bars.groupBy("symbol", F.window(time, width).alias("_w")).agg(*aggs)
    return out.select("symbol", F.col("_w.start").alias(time), "open", "high", "low", "close", "volume", "n_trades")


def stream_sliding(bars: DataFrame, size: str, slide: str, time: str = "open_time") -> DataFrame:
    """Rolling features at window scale: mean, deviation and range of the closes, volume."""
    out = bars.groupBy("symbol", F.window(time, size, slide).alias("_w")).agg(
        F.avg("close").alias("close_mean"), F.stddev_pop("close").alias("close_std"),
        (F.max("high") - F.min("low")).alias("price_range"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_bars"),
    )
    return out.select("symbol", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                      "close_mean", "close_std", "price_range", "volume", "n_bars")


def as_batch(bars: DataFrame) -> DataFrame:
    """Stream rows -> stored bar columns (UTC wall-clock times), with their arrival if they have one."""
    ntz = bars if is_ntz(bars, "open_time") else bars.withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))
    return ntz.select(*reconcile_columns(ntz), *[c for c in ntz.columns if c == "arrival"])


def upsert_batches(path: str, source: str, after: Callable[[DataFrame, int], None] | None = None):
    """A ``foreachBatch`` function: merge each batch into the store, then call
    ``after(batch, batch_id)``.

    A batch takes the next version of the store and keeps it if it is repeated:
    it overwrites what backfills and other streams wrote before it, and a
    repetition changes nothing, even if others have written since.
    """
    alone = uuid.uuid4().hex

    def run(batch: DataFrame, batch_id: int) -> None:
        bars = as_batch(batch)
        upsert_bars(bars, path, source, writer=stream_of(batch, alone), batch=batch_id)
        if after:
            after(bars, batch_id)

    return run


def commit_batches(path: str, source: str, after: Callable[[DataFrame, int], None] | None = None, compact_at: int = 20):
    """As ``upsert_batches``, into a table of immutable commits (``sources/snapshots.py``).

    A batch writes only its own rows, and readers see it whole or not at all.
    Months that ``compact_at`` commits hold are rewritten as one; old files stay
    for running readers until someone calls ``vacuum``.
    """
    alone = uuid.uuid4().hex

    def run(batch: DataFrame, batch_id: int) -> None:
        bars = as_batch(batch)
        commits.upsert(bars, path, source, writer=stream_of(batch, alone), batch=batch_id)
        commits.compact(batch.sparkSession, path, compact_at)
        if after:
            after(bars, batch_id)

    return run


def corrections(batch: DataFrame, path: str, source: str, freq: str) -> DataFrame:
    """Resampled bars of the buckets a batch touched, from the merged store.

    Late rows that streaming aggregation no longer takes come out here as new
    versions of bars that were emitted before.
    """
    spark = batch.sparkSession
    buckets = resample(batch, freq).select("symbol", "open_time")
    # The days that the touched buckets cover, of the touched symbols only.
    span = F.sequence(F.to_date("open_time"), F.to_date(F.col("open_time") + F.expr(f"INTERVAL {interval_minutes(freq) - 1} MINUTES")))
    days = with_layout(buckets, source).withColumn("dt", F.explode(span))
    where = touched(days)
    if where is None:
        return resample(batch, freq)
    fresh = resample(scan_bars(spark, path, source=source, within=where), freq, aggs=OHLCV_TRADES)
    return fresh.join(buckets, ["symbol", "open_time"], "left_semi")


def snapshots(bars: DataFrame, time: str = "open_time") -> DataFrame:
    """(open_time, bars by symbol) of a batch, for callbacks.

    One row per open time with one struct per symbol that reported.
    """
    fields = [c for c in bars.columns if c != time]
    return bars.groupBy(time).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("bars"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there into Parquet and stop."""
    (
        stream.writeStream.outputMode(mode).format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )


def run_batches(stream: DataFrame, fn, checkpoint: str, mode: str = "update") -> None:
    (
        stream.writeStream.outputMode(mode).foreachBatch(fn)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )


def run_until_quiet(stream: DataFrame, fn, checkpoint: str, quiet_s: float, limit_s: float = 600) -> None:
    """Run on the clock, so that timers fire, until no batch has given rows for ``quiet_s`` seconds after some did; for tests and catch-up jobs.

    ``fn(batch, batch_id)`` gets the batches that have rows.  The run ends after
    ``limit_s`` seconds in any case.
    """
    last: list[float] = []
    quiet = threading.Event()

    def run(batch: DataFrame, batch_id: int) -> None:
        # Both readers of a batch see one run of the state.
        batch.persist()
        try:
            if not batch.isEmpty():
                fn(batch, batch_id)
                last.append(time.monotonic())
            elif last and time.monotonic() - last[-1] >= quiet_s:
                quiet.set()
        finally:
            batch.unpersist()

    running = stream.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime="500 milliseconds").start()
    end = time.monotonic() + limit_s
    try:
        while running.isActive and time.monotonic() < end and not quiet.wait(0.1):
            pass
        failure = running.exception()
    finally:
        running.stop()
    if failure:
        raise failure
