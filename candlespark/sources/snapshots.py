"""A bar table of immutable files: writers add, readers merge, a listing is the snapshot.

* ``data/commit=<name>/source=/symbol_key=/month=``: what one upsert wrote, one
  row per bar, sorted by time.  Nothing in it changes afterwards.
* ``_commits/<name>``: a small file that makes the folder part of the table.  It
  names the months that the commit holds and, for a compaction, the months of
  other commits that it stands for.  It appears by one rename.

A reader lists ``_commits`` once; that list is its snapshot.  A commit that comes
later, or one that never ended, is not in it, and its own files stay where they
are until ``vacuum``.  So a reader sees the table before or after an upsert,
never between, and writers never wait for each other: a commit only adds, and
two compactions of the same months only hold the same rows twice.

Rows of a month that one commit holds are read as they are; only months with
several commits are merged, newest version first (``versions.py``).  An upsert
writes its own rows and reads nothing; ``compact`` rewrites the months that many
commits have touched.  What the driver holds is a list of commits and months.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlespark.schema import BAR_SCHEMA
from candlespark.session import hadoop_path, remove_dir
from candlespark.sources import versions
from candlespark.sources.bars import BAR_COLUMNS, VERSION, _key, dedupe, reconcile_columns, time_range, with_layout

FOLDERS = ["source", "symbol_key", "month"]
KEY = ["source", "symbol", "open_time"]
_LONG = [T.StructField(n, T.LongType()) for n in ("ingested_at", "arrival")]


def _schema() -> T.StructType:
    return T.StructType([*BAR_SCHEMA.fields, *_LONG, *[T.StructField(n, T.StringType()) for n in ("commit", *FOLDERS)]])


@dataclass
class Commit:
    name: str
    months: list[str]
    replaces: dict[str, list[str]] = field(default_factory=dict)

    @property
    def tick(self) -> int:
        return int(self.name.split("-")[0])


def commits(spark: SparkSession, path: str, at: int | None = None) -> list[Commit]:
    """All commits, oldest first; ``at``: only those up to this version."""
    fs, target = hadoop_path(spark, f"{path}/_commits")
    found = []
    for status in fs.listStatus(target) if fs.exists(target) else []:
        name = status.getPath().getName()
        if name[0] not in "._" and (at is None or int(name.split("-")[0]) <= at):
            stream = fs.open(status.getPath())
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            found.append(Commit(name, **json.loads(text)))
    return sorted(found, key=lambda c: c.name)


def live_months(snapshot: Sequence[Commit]) -> dict[str, list[str]]:
    """By month, the commits that a reader has to look at."""
    gone = {(name, month) for c in snapshot for name, months in c.replaces.items() for month in months}
    out = defaultdict(list)
    for c in snapshot:
        for month in c.months:
            if (c.name, month) not in gone:
                out[month].append(c.name)
    return dict(out)


def _publish(spark: SparkSession, path: str, commit: Commit) -> None:
    fs, target = hadoop_path(spark, f"{path}/_commits/{commit.name}")
    _, scratch = hadoop_path(spark, f"{path}/_commits/.{uuid.uuid4().hex}")
    out = fs.create(scratch)
    out.write(json.dumps({"months": commit.months, "replaces": commit.replaces}).encode())
    out.close()
    fs.rename(scratch, target)


def _write(rows: DataFrame, path: str, name: str) -> list[str]:
    """Write a commit's folder; the months in it."""
    folder = f"{path}/data/commit={name}"
    parted = rows.repartition(*FOLDERS).sortWithinPartitions(*FOLDERS, "open_time")
    parted.write.mode("overwrite").partitionBy(*FOLDERS).parquet(folder)
    spark = rows.sparkSession
    # One row per month of the calendar, and only folder names are read for it.
    return sorted(r.month for r in _read(spark, path, [name]).select("month").distinct().collect())


def _read(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    folders = [f"{path}/data/commit={n}" for n in names]
    return spark.read.schema(_schema()).option("basePath", f"{path}/data").parquet(*folders)


def upsert(new: DataFrame, path: str, source: str, writer: str | None = None, batch: int = 0) -> int:
    """Add ``new`` as a commit and return its version; reads nothing of the table.

    ``writer`` and ``batch`` name a batch that may be repeated: it keeps its
    version, and nothing happens if it is part of the table already.  A column
    ``arrival`` decides between copies of a bar within the batch.
    """
    spark = new.sparkSession
    tick = versions.claim(spark, path, writer, batch)
    name = f"{tick:020d}-upsert"
    if any(c.name == name for c in commits(spark, path)):
        return tick
    have = {c.lower(): c for c in new.columns}
    arrival = (F.col(have["arrival"]) if "arrival" in have else F.lit(None)).cast("long").alias("arrival")
    bars = new.select(*reconcile_columns(new), F.lit(tick).cast("long").alias("ingested_at"), arrival)
    rows = with_layout(bars, source).withColumn("month", _month("open_time")).drop("dt")
    _publish(spark, path, Commit(name, _write(dedupe(rows, KEY, VERSION), path, name)))
    return tick


def _month(time: str) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM"), F.lit("none"))


def scan(
    spark: SparkSession, path: str, symbols: Sequence[str] | None = None, start=None, end=None,
    source: str | None = None, at: int | None = None,
) -> DataFrame:
    """The bars of the newest snapshot, or of version ``at`` (until ``vacuum`` removes what it needs).

    Symbol, source and time conditions prune folders and row groups of each commit.
    """
    return _merged(spark, path, live_months(commits(spark, path, at)), symbols, start, end, source).select("source", *BAR_COLUMNS, "ingested_at")


def _merged(spark, path, live, symbols=None, start=None, end=None, source=None) -> DataFrame:
    low, high = (None if t is None else spark.range(1).select(_month_of(t)).first()[0] for t in (start, end))
    live = {m: names for m, names in live.items() if (low is None or m >= low) and (high is None or m <= high)}
    if start is not None or end is not None:
        live.pop("none", None)  # a bar without a time is in no range of times
    alone, several = defaultdict(list), defaultdict(list)
    for month, names in live.items():
        # Months with the same commits share one scan.
        (alone if len(names) == 1 else several)[tuple(names)].append(month)

    def rows(names, months):
        df = _read(spark, path, names).where(F.col("month").isin(*months))
        if source is not None:
            df = df.where(F.col("source") == source)
        if symbols is not None:
            df = df.where(F.col("symbol_key").isin(*[_key(s) for s in symbols]) & F.col("symbol").isin(*symbols))
        return time_range(df, start, end)

    parts = [rows(names, months) for names, months in sorted(alone.items())]
    if several:
        both = [rows(names, months) for names, months in sorted(several.items())]
        parts.append(dedupe(_stacked(both), KEY, VERSION))
    return _stacked(parts) if parts else spark.createDataFrame([], _schema())


def _month_of(time) -> Column:
    return F.date_format(F.lit(time).cast("timestamp_ntz"), "yyyy-MM")


def _stacked(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def compact(spark: SparkSession, path: str, at_least: int = 2) -> int | None:
    """Rewrite the months that ``at_least`` commits hold as one commit; its version, or None if there is nothing to do.

    Bars keep their versions, so an upsert that comes meanwhile still wins or loses as before.
    """
    live = {m: names for m, names in live_months(commits(spark, path)).items() if len(names) >= at_least}
    if not live:
        return None
    replaces = defaultdict(list)
    for month, names in sorted(live.items()):
        for name in names:
            replaces[name].append(month)
    tick = versions.claim(spark, path)
    name = f"{tick:020d}-compact"
    months = _write(_merged(spark, path, live).drop("commit"), path, name)
    _publish(spark, path, Commit(name, months, dict(replaces)))
    return tick


def vacuum(spark: SparkSession, path: str, before: int) -> list[str]:
    """Remove commits that nothing in the newest snapshot needs and that a compaction up to version ``before`` replaced.

    Readers of snapshots older than ``before`` lose their files; newer ones do not.
    """
    snapshot = commits(spark, path)
    live = {name for names in live_months([c for c in snapshot if c.tick <= before]).values() for name in names}
    dead = [c for c in snapshot if c.tick <= before and c.name not in live]
    # Oldest first: what a compaction replaced goes before the compaction itself.
    for c in dead:
        remove_dir(spark, f"{path}/_commits/{c.name}")
        remove_dir(spark, f"{path}/data/commit={c.name}")
    return [c.name for c in dead]
