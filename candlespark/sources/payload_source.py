"""Candle payloads as a Spark data source, in batch and as a stream: format ``candles``.

A folder holds payload files, one JSON array of candle arrays each, below a
folder per symbol (``symbol=BTCUSDT/....json``).  Options: ``path``, and
``files`` (at most so many per partition; 64 by default).  The schema is the
bars' own, with the file's name and modification time as ``arrival``.

* **Batch.** The driver lists names only; executors read and parse the files,
  ``files`` to a partition, a row at a time as Arrow batches.
* **Stream.** An offset is the listing's highest (modification time, name); a
  batch takes the files beyond its start up to its end, so a restart repeats
  and drops nothing.  Writers must move files in whole, with times that do not
  go back.
* **Values.** As ``payloads.land_klines``: numbers come as strings, values that
  are no numbers are NULL, a payload that is no array gives no rows.

Paths are what executors and driver can open alike: a mounted shared folder.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Positions in a candle array.
POSITIONS = {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 5, "quote_volume": 7, "n_trades": 8}
SCHEMA = (
    "symbol STRING, open_time TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, quote_volume DOUBLE, "
    "n_trades BIGINT, arrival BIGINT, file STRING"
)
ARROW = pa.schema([
    ("symbol", pa.string()), ("open_time", pa.timestamp("us", tz="UTC")), *[(n, pa.float64()) for n in list(POSITIONS)[:-1]],
    ("n_trades", pa.int64()), ("arrival", pa.int64()), ("file", pa.string()),
])
FILES = 64
#: Rows of one Arrow batch.
ROWS = 10_000


def listed(path: str) -> list[tuple[int, str, str]]:
    """(modification time in ms, name below ``path``, symbol) of all payload files, in that order."""
    out = []
    for entry in os.scandir(path):
        if entry.is_dir() and entry.name.startswith("symbol="):
            symbol = unquote(entry.name.removeprefix("symbol="))
            for f in os.scandir(entry.path):
                if f.is_file() and f.name.endswith(".json"):
                    out.append((f.stat().st_mtime_ns // 1_000_000, f"{entry.name}/{f.name}", symbol))
    return sorted(out)


def number(x, kind):
    if x is None or isinstance(x, bool):
        return None
    try:
        value = kind(x)
    except (TypeError, ValueError):
        return None
    return value


def candles(text: str) -> Iterator[tuple]:
    """(open time in ms, values) of a payload; what is no candle gives nothing, what is no number is None."""
    try:
        payload = json.loads(text, parse_float=str, parse_int=str)
    except ValueError:
        return
    for k in payload if isinstance(payload, list) else []:
        if isinstance(k, list):
            at = dict(enumerate(k))
            yield number(at.get(0), int), *[number(at.get(i), int if n == "n_trades" else float) for n, i in POSITIONS.items()]


class Files(InputPartition):
    def __init__(self, files: list[tuple[int, str, str]]):
        super().__init__(files)


class _Reading:
    """What both readers share: options, and rows of a partition."""

    def __init__(self, options: dict):
        self.path, self.files = options["path"], int(options.get("files", FILES))

    def dealt(self, files: list[tuple[int, str, str]]) -> list[Files]:
        return [Files(files[k : k + self.files]) for k in range(0, len(files), self.files)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for arrival, name, symbol in partition.value:
            with open(os.path.join(self.path, name), encoding="utf-8", errors="replace") as f:
                text = f.read()
            for time, *values in candles(text):
                rows.append((symbol, None if time is None else time * 1000, *values, arrival, name))
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class CandleReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.dealt(listed(self.path)) or [Files([])]


class CandleStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        files = listed(self.path)
        return {"time": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["name"]), (end["time"], end["name"])
        return self.dealt([f for f in listed(self.path) if low < f[:2] <= high]) or [Files([])]

    def commit(self, end: dict) -> None:
        """Nothing is kept per batch: the checkpoint has the offsets."""


class CandleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CandleReader:
        return CandleReader(self.options)

    def streamReader(self, schema) -> CandleStreamReader:
        return CandleStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("candles")`` and ``spark.readStream.format("candles")`` known."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CandleSource)
