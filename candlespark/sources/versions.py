"""One order of versions for all writers of a store.

A version is the next tick of the store's clock, and a claimed tick belongs to
one batch of one writer for ever: a repeated batch finds its own tick again, and
whoever claims later, a backfill or a stream, is newer than all before.  The
clock is a folder of empty files beside the data, ``_versions``, which readers
of the store do not see:

* ``_versions/clock/<tick>``: claimed ticks.  Creating a file is the claim, so
  two writers never get the same one (the file system must refuse to create a
  file twice, as HDFS and local disks do).
* ``_versions/writers/<writer>/<batch>-<tick>``: what a writer's batch got.

Old entries are removed as new ones come; both folders stay small.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

from candlespark.session import hadoop_path, remove_dir

CLOCK = "_versions"
#: Entries that each folder keeps; a stream repeats its last batch only.
KEPT = 50


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def _create(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop_path(spark, path)
    fs.mkdirs(target.getParent())
    return fs.createNewFile(target)


def newest(spark: SparkSession, path: str) -> int:
    """The newest tick claimed so far, 0 if none is."""
    ticks = _names(spark, f"{path}/{CLOCK}/clock")
    return int(ticks[-1]) if ticks else 0


def advance(spark: SparkSession, path: str, tick: int) -> None:
    """The clock goes on from ``tick`` at least."""
    if tick > newest(spark, path):
        _create(spark, f"{path}/{CLOCK}/clock/{tick:020d}")


def claim(spark: SparkSession, path: str, writer: str | None = None, batch: int = 0, after: int = 0) -> int:
    """The version of ``writer``'s ``batch``: its old tick if it has one, else the next.

    Without a writer the batch is one of its own.  ``after``: versions up to
    this one are taken already, as in a store that has rows but no clock.
    """
    name = re.sub(r"[^A-Za-z0-9_.-]", "_", writer or uuid.uuid4().hex)
    mine = f"{path}/{CLOCK}/writers/{name}"
    had = [n.split("-") for n in _names(spark, mine)] if writer else []
    for number, tick in had:
        if int(number) == batch:
            return int(tick)
    tick = max(newest(spark, path), after) + 1
    while not _create(spark, f"{path}/{CLOCK}/clock/{tick:020d}"):
        tick += 1
    if writer:
        _create(spark, f"{mine}/{batch:020d}-{tick}")
        for number, old in had[: max(len(had) + 1 - KEPT, 0)]:
            remove_dir(spark, f"{mine}/{number}-{old}")
    for old in _names(spark, f"{path}/{CLOCK}/clock")[:-KEPT]:
        remove_dir(spark, f"{path}/{CLOCK}/clock/{old}")
    return tick


def stream_of(batch, default: str) -> str:
    """The stream a micro-batch belongs to: its checkpoint keeps this name through restarts."""
    return batch._jdf.sparkSession().sparkContext().getLocalProperty("sql.streaming.queryId") or default
