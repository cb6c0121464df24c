"""Damage inside stored Parquet files: which row groups do not decode, and the rows of all others.

A scan with ``ignoreCorruptFiles`` ends a file at its first broken page and says
nothing, so the good row groups behind it are lost.  Here executors walk each
file row group by row group.  The listing carries path and length only; Spark
packs files into tasks by length.

Defined results: a valid file without rows gives no row of either table; a file
without a readable footer gives one row with ``row_group`` NULL; a row group
that lacks a column has NULLs there; one whose values do not fit the declared
types counts as damaged.  Nothing is deleted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from candlespark.schema import BAR_SCHEMA

#: Rows decoded at a time; a row group is never held whole.
BATCH_ROWS = 65_536
DAMAGE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("row_group", T.IntegerType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)
ARROW_DAMAGE, ARROW_BARS = to_arrow_schema(DAMAGE), to_arrow_schema(BAR_SCHEMA)


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow's file system of a listed path and the path there."""
    match = re.fullmatch(r"([A-Za-z0-9+.-]+):/(?:/([^/]*))?(/?.*)", path)
    if not match or match.group(1) == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + match.group(3).lstrip("/") if match else path
    scheme, host, rest = match.groups()
    fs, base = pyarrow.fs.FileSystem.from_uri(f"{scheme}://{host or ''}/")
    return fs, base.rstrip("/") + "/" + rest.lstrip("/")


def open_stored(path: str):
    """A seekable handle on a file of the store, on any file system that Arrow knows."""
    fs, at = located(path)
    return fs.open_input_file(at)


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every data file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def _failure(exc: Exception) -> str:
    return f"{type(exc).__name__}: {(str(exc).splitlines() or [''])[0]}"[:500]


def _as_bars(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The declared columns by lower-case name; ``trades_done`` is read as ``n_trades``."""
    have = {name.lower(): i for i, name in enumerate(batch.schema.names)}
    have.setdefault("n_trades", have.get("trades_done"))
    columns = []
    for field in ARROW_BARS:
        at = have.get(field.name)
        columns.append(pa.nulls(batch.num_rows, field.type) if at is None else batch.column(at).cast(field.type, safe=False))
    return pa.RecordBatch.from_arrays(columns, schema=ARROW_BARS)


def _bars(file: pq.ParquetFile, group: int) -> Iterator[pa.RecordBatch]:
    for batch in file.iter_batches(BATCH_ROWS, row_groups=[group], use_threads=False):
        yield _as_bars(batch)


def _groups(path: str, opener: Callable) -> Iterator[tuple[pq.ParquetFile | None, int | None, int | None, str | None]]:
    """(file, row group, rows, error) of each row group; one entry without a group where the footer is broken."""
    # A file that can't be opened ends the job; once it is open, what the decoder raises is a finding.
    with opener(path) as handle:
        try:
            file = pq.ParquetFile(handle, page_checksum_verification=True)
        except Exception as exc:
            yield None, None, None, _failure(exc)
            return
        for group in range(file.num_row_groups):
            error = None
            try:
                for _ in _bars(file, group):
                    pass
            except Exception as exc:
                error = _failure(exc)
            yield file, group, file.metadata.row_group(group).num_rows, error


def damaged_parts(spark: SparkSession, path: str, opener: Callable = open_stored) -> DataFrame:
    """(path, length, row_group, n_rows, error) of what can't be decoded, checksums included."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for item in files.to_pylist():
                found = [
                    {**item, "row_group": group, "n_rows": n, "error": error}
                    for _, group, n, error in _groups(item["path"], opener)
                    if error is not None
                ]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=ARROW_DAMAGE)

    return stored_files(spark, path).mapInArrow(walk, DAMAGE)


def intact_rows(spark: SparkSession, path: str, opener: Callable = open_stored) -> DataFrame:
    """The bars of every row group that decodes whole, also behind a damaged one.

    A row group is decoded twice, once to prove it and once to hand it on, so
    that neither half a row group comes out nor a whole one is held.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for path in files.column("path").to_pylist():
                for file, group, _, error in _groups(path, opener):
                    if group is not None and error is None:
                        yield from _bars(file, group)

    return stored_files(spark, path).mapInArrow(walk, BAR_SCHEMA)
