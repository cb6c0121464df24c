"""Word hashing over Arrow batches, and helpers that several operators share.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``.  A batch is hashed with
numpy in one sweep: no word becomes a Python object.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespark.session import prepare, shared_dir

# The white space that parts words, and the letters that are folded.
WHITE = b" \t\n\x0b\x0c\r"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes that one numpy sweep handles; bounds a worker's memory.
SWEEP = 1 << 20


#: Rows of an Arrow batch: whole texts can be long, and a worker holds a batch at a time.
BATCH_ROWS = 1000


def session(spark: SparkSession) -> SparkSession:
    """What these jobs ask of a session: UTC, and Arrow batches that fit a small worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return prepare(spark)


def shipped(module: str) -> None:
    """Functions of ``module`` travel with the task, so executors need no copy of the repository."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two xor-shift-multiply rounds)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Tables:
    """Lookup tables by byte: separator or not, and a 64-bit code of the folded byte."""

    apart: np.ndarray
    code: np.ndarray
    power: np.ndarray
    inverse: np.ndarray

    def reach(self, n: int) -> None:
        """Powers of the base, and of its inverse modulo 2**64, up to ``n``."""
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            base = 0x5851F42D4C957F2D
            ones = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
            for x in ones:
                x[0] = 1
            self.power, self.inverse = (np.cumprod(x, dtype=np.uint64) for x in ones)


def tables(fold: bool = True, also_apart: bytes = b"") -> Tables:
    """``fold``: A-Z count as a-z; ``also_apart``: more bytes that part words."""
    lower = np.arange(256)
    if fold:
        lower[list(UPPER)] += 32
    apart = np.zeros(256, bool)
    apart[list(WHITE + also_apart)] = True
    code = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[lower]
    return Tables(apart, code, np.empty(0, np.uint64), np.empty(0, np.uint64))


@dataclass
class Words:
    """The words of a run of documents: hash, byte span, and number of the document in the run."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  #: of each document, and the total

    def __len__(self) -> int:
        return len(self.hash)


def words(data: np.ndarray, bounds: np.ndarray, t: Tables) -> Words:
    """Words of the documents ``data[bounds[i]:bounds[i + 1]]``."""
    inside = ~t.apart[data]
    fresh, last = inside.copy(), inside.copy()
    cut = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))] if len(data) else bounds[:0]
    if len(data):
        before, after = inside[:-1].copy(), inside[1:].copy()
        before[cut - 1] = False
        after[cut - 1] = False
        fresh[1:] &= ~before
        last[:-1] &= ~after
    start, end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + SWEEP, "right")))
        low, high = int(start[at]), int(end[to - 1])
        t.reach(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(t.code[data[low:high]] * t.power[: high - low], out=sums[1:])
        a, b = start[at:to] - low, end[at:to] - low
        out[at:to] = (sums[b] - sums[a]) * t.inverse[a] + (b - a).astype(np.uint64)
        at = to
    first = np.searchsorted(start, bounds, "left")
    return Words(mix(out), start, end, np.repeat(np.arange(len(bounds) - 1), np.diff(first)), first)


def runs(column: pa.Array, limit: int = SWEEP, most: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``[a, b)`` of a string column, ``limit`` bytes or ``most`` rows at a time: their bytes and bounds. Null counts as empty.

    A longer text makes a run of its own; no text is cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if not n:
        return
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n, a + most)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size``-word shingles and the bounds of each document; fewer words: the whole sequence as one."""
    n = np.diff(w.first)
    kept = np.maximum(n - size + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate([[0], np.cumsum(kept)])
    if not len(w):
        return np.empty(0, np.uint64), bounds
    position = np.arange(bounds[-1]) - np.repeat(bounds[:-1], kept) + np.repeat(w.first[:-1], kept)
    left = np.repeat(np.minimum(n, size), kept)
    out = np.full(len(position), 0x2545F4914F6CDD1D, np.uint64)
    for k in range(size):
        at = np.minimum(position + k, len(w) - 1)
        with np.errstate(over="ignore"):
            step = (out ^ w.hash[at]) * np.uint64(0xC2B2AE3D27D4EB4F)
        step ^= step >> np.uint64(29)
        out = step if k < 1 else np.where(left > k, step, out)
    return mix(out + left.astype(np.uint64)), bounds


def crc_of_id(column: str | Column = "doc_id") -> Column:
    """crc32 of the id written as text."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(c, UPPER.decode(), UPPER.decode().lower())


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later branches and retries start from the files."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


shipped(__name__)
