"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as
sorted hash arrays, memory-mapped by the workers that score.

A model of order n takes n + 1 sweeps over the text, each without a shuffle of
rows per token; only the last one reads texts that are not learned from.  A
task gathers about a million tokens, numbers their distinct grams, and counts
and looks up by number, so each gram is searched once a gathering and a range
of the model is visited once a gathering, however many ranges there are:

1. The n-grams: every task packs the distinct ones it sees, cut by hash range;
   one task per range merges them into a sorted array with counts.
2. Each level below, from n - 1 down to single words: with the level above
   mapped, every occurrence of a gram (u, ..., w) gives 1 / count to the
   continuation count of its last words and to the follower classes of its
   first words, so each distinct gram counts exactly once; merged by hash range.
3. ``score``: the arrays of all levels are mapped and searched with sorted queries;
   what depends on a gram or a context alone is computed once for each.

The n-grams of a text begin with n - 1 begin marks.  The arrays live in the
shared folder, one file per level and hash range, and grow with the corpus; a
worker's own memory does not, since mapped pages belong to the file.  Hashes
lie together and aligned, so a search touches a few pages and copies nothing.
Counts take a byte, larger ones (of any size up to 2^53) a row in a side table.
Files are written under a temporary name and renamed, so a lost or repeated
task leaves the same bytes.  A store that cannot be mapped is copied range by
range into unlinked scratch files.

Defined results: null text is an empty text, whose only token is the end;
with no training text every score is that of an empty vocabulary (uniform over
the unknown word); repeated ids are scored row by row; extra columns stay out
of the way because only the id and the text are read.
"""

from __future__ import annotations

import itertools
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import Words, mix, runs, shipped, tables, words
from candlespark.session import shared_dir

#: Hashes of the marks before the first and after the last word.
BEGIN, END = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA41B56C4E9)
#: Words of a gram at the highest level.
ORDER = 3
#: Text bytes per hash range and word of context: bounds the arrays that one merging task holds.
RANGE_BYTES = 24 << 20
#: Tokens that a task gathers before it looks up their grams: every gathering visits all ranges, whose number grows with the corpus.
GATHER = 1 << 20
#: Grams or counts that a task packs together; bounds a worker's memory.
PACK = 1 << 20
#: Text bytes hashed at a time.
SWEEP_BYTES = 1 << 17
#: Spark's setting that removes the shuffle files of a job when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: What a level keeps of a gram: how often it ends at a token, in how many ways it goes on to the left, and as a context
#: the sum of its followers' counts and how many of them have the counts 1, 2 and more.  The highest level has ``raw`` alone.
FIELDS = ["raw", "cont", "total", "n1", "n2", "n3"]
#: A count of this size or more is kept in the side table.
WIDE = 255


@dataclass
class Model:
    """Where the arrays are, and the numbers that hold for the whole corpus."""

    folder: str
    ranges: int
    order: int = ORDER
    written: dict[int, set[int]] = field(default_factory=dict)  #: by level, the ranges that hold anything
    tokens: int = 0  #: training tokens, ends included
    vocabulary: int = 0  #: distinct training tokens
    discounts: dict[int, list[float]] = field(default_factory=dict)  #: by level
    continuations: float = 0.0  #: distinct pairs
    spare: float = 1.0  #: mass that the unigram level leaves to the uniform distribution

    def fields(self, level: int) -> list[str]:
        return FIELDS[:1] if level == self.order else FIELDS

    def counted(self, level: int) -> str:
        """The field that the level's probabilities come from."""
        return "raw" if level == self.order else "cont"


def discounts(n: list[float]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more from the numbers of types seen 1 to 4 times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


def discount_of(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.where(c <= 0, 0.0, np.where(c < 1.5, d[0], np.where(c < 2.5, d[1], d[2])))


# --- files in the shared folder --------------------------------------------


def _plain(path: str) -> str | None:
    """The path on a mounted file system, or None for another store."""
    if "://" not in path and not path.startswith("file:"):
        return path
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else None


def _put(path: str, arrays: list[np.ndarray]) -> None:
    plain = _plain(path)
    if plain is None:
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_output_stream(at) as out:
            for data in arrays:
                out.write(data.tobytes())
        return
    os.makedirs(os.path.dirname(plain), exist_ok=True)
    part = f"{plain}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        for data in arrays:
            data.tofile(out)
    os.replace(part, plain)


def _put_rows(path: str, keys: np.ndarray, counts: np.ndarray) -> None:
    """Two lengths, ascending hashes, then the side table (hashes, eight-byte counts), then a byte per count, those of a hash together."""
    wide = np.flatnonzero((counts >= WIDE).any(axis=1))
    small = np.minimum(counts, WIDE).astype(np.uint8)
    head = np.array([len(keys), len(wide)], np.uint64)
    _put(path, [head, keys, keys[wide], np.ascontiguousarray(counts[wide].T.astype(np.uint64)), np.ascontiguousarray(small)])


def _map(path: str) -> np.ndarray:
    """The bytes of ``path``, memory-mapped; a file that should be there and isn't is an error."""
    plain = _plain(path)
    if plain is not None:
        return np.asarray(np.memmap(plain, np.uint8, "r"))
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    with tempfile.TemporaryFile() as scratch, fs.open_input_stream(at) as stream:
        while block := stream.read(8 << 20):
            scratch.write(block)
        scratch.flush()
        return np.frombuffer(mmap.mmap(scratch.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)


class Rows:
    """One range of a level: views into its mapped file."""

    def __init__(self, raw: np.ndarray, width: int):
        n, w = raw[:16].view(np.uint64).tolist()
        ends = np.cumsum([16, 8 * n, 8 * w, 8 * w * width, n * width]).tolist()
        self.hash, self.wide_hash = raw[ends[0] : ends[1]].view(np.uint64), raw[ends[1] : ends[2]].view(np.uint64)
        self.wide = raw[ends[2] : ends[3]].view(np.uint64).reshape(width, w)
        self.small = raw[ends[3] : ends[4]].reshape(n, width)

    def find(self, keys: np.ndarray, columns: list[int], out: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(self.hash, keys), len(self.hash) - 1)
        small = self.small[at]
        small[self.hash[at] != keys] = 0
        for o, c in zip(out, columns, strict=True):
            o[:] = small[:, c]
            large = np.flatnonzero(o == WIDE)
            o[large] = self.wide[c][np.searchsorted(self.wide_hash, keys[large])]


class Arrays:
    """The ranges of one level, mapped when first asked for."""

    def __init__(self, model: Model, level: int):
        self.model, self.level, self.open = model, level, {}
        self.edges = _edges(model.ranges)

    def part(self, k: int) -> Rows:
        if k not in self.open:
            self.open[k] = Rows(_map(_path(self.model, self.level, k)), len(self.model.fields(self.level)))
        return self.open[k]

    def find(self, keys: np.ndarray, columns: list[str]) -> np.ndarray:
        """The columns at ascending ``keys``, a row for each column; 0 where a key is absent."""
        out = np.zeros((len(columns), len(keys)))
        places = [self.model.fields(self.level).index(c) for c in columns]
        # Only ranges that some key falls into are looked at, however many there are.
        cuts = [*np.searchsorted(keys, self.edges).tolist(), len(keys)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            if a < b and k in self.model.written[self.level]:
                self.part(k).find(keys[a:b], places, out[:, a:b])
        return out


def _path(model: Model, level: int, part: int) -> str:
    return f"{model.folder}/level{level}-{part:06d}"


def _edges(ranges: int) -> np.ndarray:
    """The lowest hash of each range."""
    return np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)


# --- packing of what a task has seen ----------------------------------------


def _pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Ascending keys as differences, all bytes of one weight together, compressed; ``values`` has a row for each field."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(keys), 8).T) for x in (gaps, *values)]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes))


def _unpack(block: bytes, kind: np.dtype, width: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(1 + width, 8, -1)
    fields = np.empty((1 + width, planes.shape[2], 8), np.uint8)
    for k in range(8):
        fields[:, :, k] = planes[:, k]
    return np.cumsum(fields[0].view(np.uint64).ravel(), dtype=np.uint64), fields[1:].view(kind)[:, :, 0]


def _blocks(keys: np.ndarray, values: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    edges = np.searchsorted(keys, _edges(ranges)).tolist() + [len(keys)]
    full = [k for k in range(ranges) if edges[k] < edges[k + 1]]
    packed = [_pack(keys[edges[k] : edges[k + 1]], values[:, edges[k] : edges[k + 1]]) for k in full]
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packed, pa.binary())], ["part", "block"])


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending keys and, in a row for each field, the sums of their values."""
    values = np.concatenate([v for _, v in held], axis=1)
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.stack([np.bincount(at, v, len(keys)) for v in values])


def _packed(counts: Iterator[tuple[np.ndarray, np.ndarray]], ranges: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the sums of ``counts`` (ascending keys, fields), about ``PACK`` rows of them at a time."""
    held, n = [], 0
    for keys, values in counts:
        held.append((keys, values))
        n += len(keys)
        if n >= PACK:
            yield from _blocks(*_summed(held), ranges)
            held, n = [], 0
    if held:
        yield from _blocks(*_summed(held), ranges)


# --- the tokens of a text ---------------------------------------------------


@dataclass
class Grams:
    """The tokens of some documents: by level, hashes of the grams that end at each token and of the marks before the first."""

    ending: dict[int, np.ndarray]
    begin: dict[int, np.ndarray]
    starts: np.ndarray  #: first token of each document
    doc: np.ndarray  #: document of each token

    def numbered(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct grams of ``level``, ascending; by token, the number of the gram that ends there and of the one before it."""
        keys, at = np.unique(np.append(self.ending[level], self.begin[level]), return_inverse=True)
        before = np.roll(at[:-1], 1)
        before[self.starts] = at[-1]
        return keys, at[:-1], before


def _grams_of(held: list[Words], order: int) -> Grams:
    n = np.concatenate([np.diff(w.first) for w in held])
    docs = len(n)
    last = np.cumsum(n + 1) - 1
    starts = np.concatenate([[0], last[:-1] + 1])
    word = np.empty(sum(map(len, held)) + docs, np.uint64)
    own = np.ones(len(word), bool)
    own[last] = False
    word[own], word[last] = np.concatenate([w.hash for w in held]), END
    step = np.uint64(0x9E3779B97F4A7C15)
    ending, begin = {1: word}, {1: np.array([BEGIN])}
    for k in range(1, order):
        before = np.roll(ending[k], 1)
        before[starts] = begin[k]
        ending[k + 1] = mix(before * step + word)
        begin[k + 1] = mix(begin[k] * step + BEGIN)
    return Grams(ending, begin, starts, np.repeat(np.arange(docs), n + 1))


def _gathered(batches: Iterator[pa.RecordBatch], order: int, most: int) -> Iterator[tuple[pa.Table, Grams]]:
    """Whole rows without their texts, and the grams of these, about ``most`` tokens at a time."""
    t = tables()
    rows, held, n = [], [], 0
    for batch in batches:
        others = batch.drop_columns("text")
        for a, b, data, bounds in runs(batch.column("text"), SWEEP_BYTES):
            rows.append(others.slice(a, b - a))
            held.append(words(data, bounds, t))
            n += len(held[-1]) + b - a
            if n >= most:
                yield pa.Table.from_batches(rows), _grams_of(held, order)
                rows, held, n = [], [], 0
    if held:
        yield pa.Table.from_batches(rows), _grams_of(held, order)


def _merged(packed: DataFrame, ranges: int, put, kind: np.dtype, width: int) -> DataFrame:
    """Run ``put(range, keys, summed values)`` for every range that has blocks: ``part, sums``, the numbers it gives."""

    def merge(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None
        done: list[int] = []
        out: list[list[float]] = []

        def close():
            if held:
                out.append(put(now, *_summed(held)))
                done.append(now)
                held.clear()

        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block"), strict=True):
                if part != now:
                    close()
                    now = part
                held.append(_unpack(block.as_py(), kind, width))
                if len(held) > 64:
                    held[:] = [_summed(held)]
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32()), pa.array(out, pa.list_(pa.float64()))], ["part", "sums"])

    # Each range is a task of its own.
    parts = packed.repartitionById(ranges, "part").sortWithinPartitions("part")
    return parts.mapInArrow(merge, "part int, sums array<double>")


def _total(report: DataFrame, width: int) -> tuple[list[float], set[int]]:
    """Column sums of the few numbers that every range reports, and which ranges did.

    The blocks are of no use once the ranges are written, so this job's shuffle files go when it ends.
    """
    conf = report.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        row = report.agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)], F.collect_set("part").alias("parts")).first()
    finally:
        conf.set(CLEANUP, before)
    return [float(x or 0) for x in row[:width]], set(row["parts"])


def learned(docs: DataFrame, learn: str = "learn") -> DataFrame:
    """The texts to learn from, and nothing else: other rows and columns do not reach Python."""
    return docs.where(F.col(learn)).select("text")


def train(docs: DataFrame, learn: str = "learn", order: int = ORDER) -> Model:
    """Count ``docs`` (columns text and the boolean ``learn``) and write the arrays."""
    if order < 2:
        raise ValueError("an n-gram model has an order of 2 or more")
    texts = learned(docs, learn)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = Model(shared_dir(docs.sparkSession, "kneser-ney"), max(2, -(-size * (order - 1) // RANGE_BYTES)), order)
    ranges = model.ranges

    def put(level):
        fields, counted = model.fields(level), model.fields(level).index(model.counted(level))

        def write(part, keys, values):
            counts = np.rint(values).astype(np.int64)
            _put_rows(_path(model, level, part), keys, counts.T)
            seen = counts[counted][counts[0] > 0]
            classes = [float((seen == k).sum()) for k in (1, 2, 3, 4)]
            return [*classes, float((seen > 2).sum()), float(len(seen)), float(counts[0].sum())]

        return write, len(fields)

    def grams(batches):
        for _, g in _gathered(batches, order, PACK):
            keys, counts = np.unique(g.ending[order], return_counts=True)
            yield from _blocks(keys, counts.astype(np.uint64)[None], ranges)

    write, width = put(order)
    packed = texts.mapInArrow(grams, "part int, block binary")
    sums, model.written[order] = _total(_merged(packed, ranges, write, np.dtype("<u8"), width), 7)
    model.discounts[order], pairs = discounts(sums[:4]), sums[5]

    def below(level):
        # Each distinct gram of the level above is shared out among its occurrences: as an ending to the gram of
        # ``level`` that ends with it (count, continuation), and as a follower to the one it begins with.
        def shared(batches):
            above, counted = Arrays(model, level + 1), model.counted(level + 1)
            for _, g in _gathered(batches, order, GATHER):
                longer, which = np.unique(g.ending[level + 1], return_inverse=True)
                raw, value = above.find(longer, ["raw", counted])
                share, value = (1 / np.maximum(raw, 1))[which], value[which]
                keys, at, before = g.numbered(level)
                many = len(keys)
                classes = np.bincount(before * 3 + np.clip(value, 1, 3).astype(int) - 1, share, 3 * many).reshape(many, 3)
                fields = [np.bincount(at, minlength=many), np.bincount(at, share, many), np.bincount(before, share * value, many), *classes.T]
                yield keys, np.stack(fields, dtype=float)

        return lambda batches: _packed(shared(batches), ranges)

    for level in range(order - 1, 0, -1):
        write, width = put(level)
        packed = texts.mapInArrow(below(level), "part int, block binary")
        sums, model.written[level] = _total(_merged(packed, ranges, write, np.dtype("<f8"), width), 7)
        model.discounts[level] = discounts(sums[:4])
        if level == 2:
            pairs = sums[5]
    model.vocabulary, model.tokens, model.continuations = round(sums[5]), round(sums[6]), pairs
    d = model.discounts[1]
    if pairs:
        model.spare = (d[0] * sums[0] + d[1] * sums[1] + d[2] * sums[4]) / pairs
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, learn, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every row of ``docs``.

    ``docs`` has doc_id, text and ``learn``.
    """

    def scored(batches):
        levels = {k: Arrays(model, k) for k in range(1, model.order + 1)}
        total, kinds = model.tokens, model.vocabulary
        for some, g in _gathered(batches, model.order, GATHER):
            for k, arrays in levels.items():
                d = model.discounts[k]
                keys, at, context = g.numbered(k)
                found = dict(zip(model.fields(k), arrays.find(keys, model.fields(k)), strict=True))
                count = found[model.counted(k)]
                kept = np.maximum(count - discount_of(count, d), 0)[at]
                if k == 1:
                    n = found["raw"]
                    base = np.log10((n + 0.5) / (total + 0.5 * (kinds + 1)))[at]
                    known = (n > 0)[at]
                    p = np.full(len(at), model.spare / (kinds + 1))
                    if model.continuations:
                        p += kept / model.continuations
                else:
                    p = kept / follows + left * p
                if k < model.order:
                    d, follows = model.discounts[k + 1], np.maximum(found["total"], 1)
                    left = (d[0] * found["n1"] + d[1] * found["n2"] + d[2] * found["n3"]) / follows
                    left, follows = np.where(found["total"] > 0, left, 1.0)[context], follows[context]
            doc, rows = g.doc, len(g.starts)
            count = np.bincount(doc, minlength=rows)
            logp = np.bincount(doc, np.log10(p), rows)
            some = some.combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("doc_id").cast(pa.int64()),
                    some.column("learn"),
                    pa.array(count, pa.int64()),
                    pa.array(np.bincount(doc, known, rows).astype(np.int64)),
                    pa.array(np.full(rows, total, np.int64)),
                    pa.array(np.bincount(doc, base, rows)),
                    pa.array(logp),
                    pa.array(10 ** np.minimum(-logp / count, 300)),
                ],
                ["doc_id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    schema = "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select("doc_id", "text", F.coalesce(F.col("learn"), F.lit(False)).alias("learn")).mapInArrow(scored, schema)


shipped(__name__)
