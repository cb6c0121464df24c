"""Bar sources by name.

A source is a function ``(spark, symbols, start, end) -> DataFrame`` that gives
bars in any of the spellings :func:`candlespark.sources.bars.reconcile` reads.
Adding one is a call of :func:`register_source`; landing, storing, resampling
and scoring work on its bars as on all others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespark.sources.bars import reconcile, time_range, upsert_bars
from candlespark.sources.payloads import clean

BarSource = Callable[[SparkSession, Sequence[str], object, object], DataFrame]
SOURCES: dict[str, BarSource] = {}


def register_source(name: str, fetch: BarSource) -> None:
    SOURCES[name] = fetch


def fetch_bars(spark: SparkSession, name: str, symbols: Sequence[str], start=None, end=None) -> DataFrame:
    """Clean bars of a source; what it gives beyond the symbols and times asked for is cut off."""
    if name not in SOURCES:
        raise ValueError(f"no bar source {name!r}; there are {sorted(SOURCES)}")
    bars = reconcile(SOURCES[name](spark, symbols, start, end))
    return clean(time_range(bars.where(F.col("symbol").isin(*symbols)), start, end))


def sync_source(spark: SparkSession, name: str, path: str, symbols: Sequence[str], start=None, end=None, seq: int | None = None) -> None:
    """Fetch a range and merge it into the store under the source's name."""
    upsert_bars(fetch_bars(spark, name, symbols, start, end), path, name, seq)
