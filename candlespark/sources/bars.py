"""The bar store: Parquet partitioned by source, symbol key and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlespark.functions.names import symbol_key
from candlespark.operators.blocks import DAY
from candlespark.schema import BAR_SCHEMA
from candlespark.session import hadoop_path, remove_dir, shared_dir
from candlespark.sources import versions

PARTITIONS = ["source", "symbol_key", "dt"]
#: Versions of a bar: the later batch wins (``versions.py``); within a batch the last to arrive, then the one of more trades, then the larger values.
VERSION = ["ingested_at", "arrival", "n_trades", "volume", "close", "high", "low", "open"]
#: Folders named one by one in a filter; beyond that a range of days is.
NAMED = 500
BAR_COLUMNS = BAR_SCHEMA.fieldNames()
STORED = T.StructType(
    [
        *BAR_SCHEMA.fields,
        T.StructField("ingested_at", T.LongType()),
        T.StructField("arrival", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("symbol_key", T.StringType()),
        T.StructField("dt", T.DateType()),
    ]
)


def reconcile(df: DataFrame) -> DataFrame:
    """Any source's bar columns -> the nine declared fields.

    ``trades_done`` is read as ``n_trades``; missing columns become NULL.
    """
    return df.select(*reconcile_columns(df))


def reconcile_columns(df: DataFrame) -> list[Column]:
    have = {c.lower(): c for c in df.columns}
    renamed = {"n_trades": have.get("n_trades") or have.get("trades_done")}
    out = []
    for f in BAR_SCHEMA.fields:
        src = renamed.get(f.name) or have.get(f.name)
        out.append((F.col(src) if src else F.lit(None)).cast(f.dataType).alias(f.name))
    return out


def with_layout(bars: DataFrame, source: str) -> DataFrame:
    """Add the partition columns."""
    return (
        bars.withColumn("source", F.lit(source))
        .withColumn("symbol_key", symbol_key("symbol"))
        .withColumn("dt", F.to_date("open_time"))
    )


def dedupe(bars: DataFrame, keys: Sequence[str] = ("symbol", "open_time"), order: Sequence[str] = ("ingested_at",)) -> DataFrame:
    """Keep the newest version of each key.

    An aggregate rather than a window: versions are combined before the
    shuffle, so many copies of one key never meet in one task.
    """
    rest = [c for c in bars.columns if c not in keys]
    newest = bars.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v"))
    return newest.select(*keys, "_v.*").select(*bars.columns)


def time_range(df: DataFrame, start=None, end=None, time: str = "open_time") -> DataFrame:
    """Rows with start <= time <= end; dates, strings and timestamps are accepted."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end).cast("timestamp_ntz"))
    return df


def scan_bars(
    spark: SparkSession, path: str, symbols: Sequence[str] | None = None, start=None, end=None,
    source: str | None = None, skip_corrupt: bool = False, within: Column | None = None,
) -> DataFrame:
    """Read bars; symbol and time conditions prune partitions and row groups.

    ``within``: a further condition on the stored columns, partition columns included.
    """
    reader = spark.read.schema(STORED).option("ignoreCorruptFiles", str(skip_corrupt).lower())
    df = reader.parquet(path)
    if source is not None:
        df = df.where(F.col("source") == source)
    if within is not None:
        df = df.where(within)
    if symbols is not None:
        df = df.where(F.col("symbol_key").isin(*[_key(s) for s in symbols]) & F.col("symbol").isin(*symbols))
    if start is not None:
        df = df.where(F.col("dt") >= F.to_date(F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        df = df.where(F.col("dt") <= F.to_date(F.lit(end).cast("timestamp_ntz")))
    return dedupe(time_range(df, start, end), ["source", "symbol", "open_time"], VERSION)


def _key(symbol: str) -> str:
    """Driver-side form of :func:`candlespark.functions.names.symbol_key`."""
    import re

    return re.sub(r"[/\\:\- ]", "", symbol)


def touched(bars: DataFrame) -> Column | None:
    """A literal condition on the partition columns that holds for every folder ``bars`` (with layout) touches.

    The driver gets one row: bounds, and at most ``NAMED`` names of each kind,
    beyond which days become a range and symbols are left to the join that
    follows.  None if there are no rows.
    """
    few = [F.slice(F.sort_array(F.collect_set(c)), 1, NAMED + 1).alias(f"{c}_set") for c in ("symbol_key", "dt")]
    keys = bars.select("symbol_key", "dt").distinct()
    row = keys.agg(F.min("dt").alias("low"), F.max("dt").alias("high"), *few).first()
    if row.low is None:
        return None
    days = F.col("dt").isin(*row.dt_set) if len(row.dt_set) <= NAMED else F.col("dt").between(row.low, row.high)
    return days & F.col("symbol_key").isin(*row.symbol_key_set) if len(row.symbol_key_set) <= NAMED else days


def _taken(spark: SparkSession, path: str) -> int:
    """The newest version of a store that has rows but no clock yet, as stores of explicit versions may be."""
    if versions.newest(spark, path) or not _exists(spark, path):
        return 0
    return spark.read.schema(STORED).parquet(path).agg(F.max("ingested_at").alias("v")).first().v or 0


def upsert_bars(
    new: DataFrame, path: str, source: str, seq: Column | int | None = None, writer: str | None = None, batch: int = 0,
) -> None:
    """Merge bars into the store, rewriting the touched (source, symbol, day) folders.

    The version is the next tick of the store's clock, so the last to write
    wins, whoever it is; ``writer`` and ``batch`` name a batch that may be
    repeated and then keeps its version.  ``seq`` sets versions by hand, of the
    batch or of each row; the clock goes on after them.  Within a batch a column
    ``arrival`` (a number, larger is later) decides between copies of a bar.
    Only the touched folders are read: their names are literals in the scan.
    Both the batch and the merged rows are staged in the shared folder, so a
    failed overwrite never leaves the store as the only, half-written copy;
    staged copies go when the store is written.  Two writers must not rewrite
    one folder at the same time.
    """
    spark = new.sparkSession
    staged, merged_path = shared_dir(spark, "batch"), shared_dir(spark, "upsert")
    have = {c.lower(): c for c in new.columns}
    arrival = F.col(have["arrival"]) if "arrival" in have else F.lit(None)
    version = seq if isinstance(seq, Column) else F.lit(seq)
    extra = [version.cast("long").alias("ingested_at"), arrival.cast("long").alias("arrival")]
    # Versions and arrivals are read beside the declared fields, before anything is renamed.
    rows = with_layout(new.select(*reconcile_columns(new), *extra), source).select(*STORED.fieldNames())
    key = ["source", "symbol", "open_time"]
    dedupe(rows, key, VERSION).write.parquet(staged)
    marked = spark.read.schema(STORED).parquet(staged)
    where = touched(marked)
    if where is not None:
        if seq is None:
            version = versions.claim(spark, path, writer, batch, _taken(spark, path))
            marked = marked.withColumn("ingested_at", F.lit(version).cast("long"))
        else:
            versions.advance(spark, path, max(marked.agg(F.max("ingested_at").alias("v")).first().v or 0, _taken(spark, path)))
        merged = marked
        if _exists(spark, path):
            old = spark.read.schema(STORED).parquet(path).where((F.col("source") == source) & where)
            old = old.join(marked.select(*PARTITIONS).distinct(), PARTITIONS, "left_semi")
            merged = dedupe(old.unionByName(marked), key, VERSION)
        merged.write.parquet(merged_path)
        (
            spark.read.schema(STORED).parquet(merged_path)
            .repartition(*PARTITIONS)
            .sortWithinPartitions(*PARTITIONS, "open_time")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*PARTITIONS)
            .parquet(path)
        )
        remove_dir(spark, merged_path)
    remove_dir(spark, staged)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop_path(spark, path)
    return fs.exists(target) and any(s.getPath().getName()[0] not in "._" for s in fs.listStatus(target))


def latest(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return bars.groupBy(*keys).agg(F.max("open_time").alias("last_time"))


def restrict_days(bars: DataFrame, days: DataFrame, time: str = "open_time", day: str = "dt") -> DataFrame:
    """Rows whose date is in ``days``; a semi join, broadcast when small enough."""
    marked = bars.withColumn("_day", F.to_date(time))
    return marked.join(days.select(F.col(day).alias("_day")).distinct(), "_day", "left_semi").drop("_day")


def newest_rows(
    bars: DataFrame, k: int, keys: Sequence[str] = ("symbol",), time: str = "open_time", cell_s: int = DAY,
    ties: Sequence[str] = (),
) -> DataFrame:
    """The last ``k`` bars per key, without ordering a key's whole history.

    Days are counted from the newest back; only days that can hold one of the
    last ``k`` bars are ordered.
    """
    from pyspark.sql import Window

    from candlespark.functions.times import cell

    on = [*keys, "_cell"]
    rows = bars.withColumn("_cell", cell(time, cell_s))
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0))).where(F.col("_later") < k)
    w = Window.partitionBy(*on).orderBy(F.desc(time), *[F.desc(t) for t in ties])
    near = rows.join(needed.drop("_n"), on).withColumn("_rank", F.row_number().over(w) + F.col("_later"))
    return near.where(F.col("_rank") <= k).select(*bars.columns)


def tolerant_scan(spark: SparkSession, path: str) -> DataFrame:
    """All files below ``path``, skipping the ones that are no valid Parquet."""
    reader = spark.read.schema(BAR_SCHEMA).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true")
    return reader.parquet(path)


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """Files without a readable footer: (path, length); a valid file without rows is none.

    ``damage.damaged_parts`` also names the row groups whose pages are broken.
    """
    from candlespark.sources.damage import damaged_parts

    return damaged_parts(spark, path).where("row_group IS NULL").select("path", "length")
