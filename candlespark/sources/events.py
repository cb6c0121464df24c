"""The event store: Parquet by day of observation, a key index and hourly partial aggregates.

* ``observed_day=.../`` the events;
* ``_keys/bucket=.../`` the keys of all events ever stored, in hash buckets, so
  that a key is unique for ever, whenever it is observed again, and a sync reads
  the buckets of its own keys only;
* ``_partials/sync=.../`` what each sync added per target, deployment, kind and
  hour; reports merge these rows and leave the log alone;
* ``_pending/`` rows of a sync that was cut off; the next one finishes it.

One sync writes at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlespark.functions.times import MICRO
from candlespark.operators.monitor import PARTIAL, PERIODS, TARGET, new_events, partials, period_report, sums_of_partials, sums_of_periods
from candlespark.schema import EVENT_KEY, EVENT_SCHEMA
from candlespark.session import hadoop_path, remove_dir, shared_dir

DAY = "observed_day"
STORED = [*EVENT_SCHEMA.fieldNames(), DAY]
STORED_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField(DAY, T.DateType())])
KEYS, PARTIALS, PENDING = "_keys", "_partials", "_pending"
KEY_SCHEMA = T.StructType([f for f in EVENT_SCHEMA.fields if f.name in EVENT_KEY] + [T.StructField("bucket", T.IntegerType())])
#: Buckets of the key index; fixed for a store.
BUCKETS = 256


def _there(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop_path(spark, path)
    return fs.exists(target)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def scan_events(spark: SparkSession, path: str, start=None, end=None, within: Column | None = None) -> DataFrame:
    """Stored events; times bound both the day folders and the row groups."""
    if not _there(spark, path):
        return spark.createDataFrame([], STORED_SCHEMA)
    df = spark.read.schema(STORED_SCHEMA).parquet(path)
    if within is not None:
        df = df.where(within)
    if start is not None:
        df = df.where((F.col("observed_at") >= F.lit(start).cast("timestamp_ntz")) & (F.col(DAY) >= F.lit(start).cast("date")))
    if end is not None:
        df = df.where((F.col("observed_at") <= F.lit(end).cast("timestamp_ntz")) & (F.col(DAY) <= F.lit(end).cast("date")))
    return df


def bucket() -> Column:
    return F.pmod(F.xxhash64(*EVENT_KEY), F.lit(BUCKETS)).cast("int")


def stored_keys(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    """Keys of the given buckets; their numbers are literals, so other folders are not listed or read."""
    if not _there(spark, f"{path}/{KEYS}"):
        # Without rows from Python, which would start its workers.
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in KEY_SCHEMA.fields])
    return spark.read.schema(KEY_SCHEMA).parquet(f"{path}/{KEYS}").where(F.col("bucket").isin(*buckets))


def _add_keys(rows: DataFrame, path: str) -> None:
    keys = rows.select(*EVENT_KEY, bucket().alias("bucket"))
    keys.repartition("bucket").sortWithinPartitions("bucket", *EVENT_KEY).write.mode("append").partitionBy("bucket").parquet(f"{path}/{KEYS}")


def _commit(spark: SparkSession, path: str, sync: str, again: bool = False) -> None:
    """Bring the pending rows of a sync into the store; every step may be repeated."""
    pending = f"{path}/{PENDING}/{sync}"
    added = spark.read.schema(STORED_SCHEMA).parquet(pending)
    if added.isEmpty():
        remove_dir(spark, pending)
        return
    missing = added
    if again:
        days = [r[0] for r in added.select(DAY).distinct().collect()]
        missing = added.join(scan_events(spark, path, within=F.col(DAY).isin(*days)).select(*EVENT_KEY), EVENT_KEY, "left_anti")
        missing = spark.read.schema(STORED_SCHEMA).parquet(_kept(missing, "missing"))
    # A day with many rows is split over tasks and files.
    missing.hint("rebalance", DAY).sortWithinPartitions(DAY, "observed_at").write.mode("append").partitionBy(DAY).parquet(path)
    partials(added).write.mode("overwrite").parquet(f"{path}/{PARTIALS}/sync={sync}")
    _add_keys(added, path)
    remove_dir(spark, pending)


def _kept(df: DataFrame, name: str) -> str:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return path


def recover(spark: SparkSession, path: str) -> None:
    """Finish syncs that were cut off, and index a store that has events but no index yet."""
    for sync in _names(spark, f"{path}/{PENDING}"):
        if _there(spark, f"{path}/{PENDING}/{sync}/_SUCCESS"):
            _commit(spark, path, sync, again=True)
        else:
            remove_dir(spark, f"{path}/{PENDING}/{sync}")
    if any(n.startswith(DAY) for n in _names(spark, path)) and not _there(spark, f"{path}/{KEYS}"):
        partials(scan_events(spark, path)).write.mode("overwrite").parquet(f"{path}/{PARTIALS}/sync=0")
        _add_keys(scan_events(spark, path), path)


def append_events(batch: DataFrame, path: str) -> DataFrame:
    """Append the rows of ``batch`` whose key the store has never held; (topic, address, fetched, inserted).

    Of copies in the batch the earliest stays.  The keys' buckets are literals
    of the index scan; nothing is read of the log itself.
    """
    spark = batch.sparkSession
    recover(spark, path)
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields]
    staged = _kept(batch.select(*fields), "events")
    rows = spark.read.schema(EVENT_SCHEMA).parquet(staged)
    # At most BUCKETS numbers.
    buckets = [r[0] for r in rows.select(bucket().alias("b")).distinct().collect()]
    sync = uuid.uuid4().hex
    pending = f"{path}/{PENDING}/{sync}"
    fresh = new_events(rows, stored_keys(spark, path, buckets))
    fresh.withColumn(DAY, F.to_date("observed_at")).select(*STORED).write.parquet(pending)
    added = spark.read.schema(STORED_SCHEMA).parquet(pending)
    counts = rows.groupBy(*TARGET).agg(F.count(F.lit(1)).alias("fetched")).join(
        added.groupBy(*TARGET).agg(F.count(F.lit(1)).alias("inserted")), TARGET, "left"
    )
    report = _kept(counts.select(*TARGET, "fetched", F.coalesce("inserted", F.lit(0)).alias("inserted")), "sync")
    _commit(spark, path, sync)
    remove_dir(spark, staged)
    return spark.read.parquet(report)


# ------------------------------------------------------- reports from partials
def scan_partials(spark: SparkSession, path: str) -> DataFrame:
    """Partial aggregates of all syncs; rows of one key are merged by the reports."""
    if not _there(spark, f"{path}/{PARTIALS}"):
        return spark.createDataFrame([], PARTIAL)
    return spark.read.schema(PARTIAL).parquet(f"{path}/{PARTIALS}").select(*PARTIAL.fieldNames())


def advance_cursors(targets: DataFrame, path: str) -> DataFrame:
    """``targets`` with ``last_sync_at`` set to the newest stored event of each, or left as it was."""
    spark = targets.sparkSession
    newest = scan_partials(spark, path).groupBy(*TARGET).agg(F.max("newest.observed_at").alias("_newest"))
    old = F.col("last_sync_at") if "last_sync_at" in targets.columns else F.lit(None).cast("timestamp_ntz")
    return targets.join(newest, TARGET, "left").withColumn("last_sync_at", F.greatest(old, F.col("_newest"))).drop("_newest")


def stored_period_metrics(spark: SparkSession, path: str, targets: DataFrame, as_of, periods: Mapping[str, int] = PERIODS) -> DataFrame:
    """As ``monitor.period_metrics`` of the whole log: whole hours from the partials, only the hours in which a window begins from the events.

    ``as_of``: a time or its text.
    """
    now = spark.range(1).select((F.unix_micros(F.lit(as_of).cast("timestamp_ntz").cast("timestamp"))).alias("t")).first().t
    hour = 3600 * MICRO
    starts = {label: now - seconds * MICRO for label, seconds in periods.items()}
    whole = {label: -(-start // hour) * hour for label, start in starts.items()}

    def at(us: int) -> Column:
        return F.timestamp_micros(F.lit(us)).cast("timestamp_ntz")

    edges = F.lit(False)
    for label in periods:
        day = F.to_date(at(starts[label]))
        edges = edges | ((F.col(DAY) == day) & (F.col("observed_at") >= at(starts[label])) & (F.col("observed_at") < at(whole[label])))
    edge_events = scan_events(spark, path, within=edges)
    inside = {label: (F.col("observed_at") >= at(starts[label])) & (F.col("observed_at") < at(whole[label])) for label in periods}
    from_hours = sums_of_partials(scan_partials(spark, path), {label: F.col("hour") >= at(whole[label]) for label in periods})
    return period_report(from_hours.unionByName(sums_of_periods(edge_events, inside)), targets, list(periods))
