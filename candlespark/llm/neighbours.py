"""Quality by nearest-neighbour voting in a latent-semantic space.

A text has two kinds of terms: its byte trigrams, hashed to ``TERMS`` columns and
weighted by log frequency and by the rarity of the term over all documents; and
how far back each of its words occurred last, by powers of two (``GAPS``
columns, the last for words that are new), which no bag of substrings shows.
Both are directions of equal length.  The space is spanned by the leading
singular vectors of a labelled sample.

The sample has at most ``labelled`` rows, those of least hash, so the vectors
that go to every worker have a proven size (4,096 x 32 floats: half a
megabyte).  Every document is compared with all of them, block by block, by
cosine; the ``VOTES`` nearest vote with weights that grow with similarity.
Document frequencies cover all rows.

Defined results: null, empty and blank texts have no direction and take the
share of label 1 in the sample; without labelled rows every score is 0.5; a
row labelled twice counts with its lower label; of several texts of a labelled
id the least is taken; of labelled rows equally near the one with the lower id
votes; repeated ids are scored row by row; an empty table gives no rows; extra
columns are not read.  Texts are never cut: a text longer than a run is a block
of its own, with memory some tens of times its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import runs, shipped, tables, words

LABELLED = 4096
TERMS = 2048
GAPS = 16
DIMENSIONS = 32
VOTES = 15
SHARPNESS = 16
#: Texts that are compared at a time.
BLOCK = 512


@dataclass
class Space:
    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def _blocks(column: pa.Array):
    """First row, term counts (texts x terms), shares of recurring words by gap, and whether a text has words, of each block of a text column."""
    by_word = tables(fold=False)
    for a, b, data, bounds in runs(column, most=BLOCK):
        n = b - a
        doc = np.repeat(np.arange(n), np.diff(bounds))
        wide = data.astype(np.uint64)
        trigram = (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]
        slot = ((trigram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TERMS.bit_length() + 1)).astype(np.int64)
        inside = doc[:-2] == doc[2:]
        counts = np.bincount(doc[:-2][inside] * TERMS + slot[inside], minlength=n * TERMS).reshape(n, TERMS)
        w = words(data, bounds, by_word)
        order = np.lexsort((w.hash, w.doc))  # stable: equal words stay in their order
        again = np.append(False, (w.hash[order][1:] == w.hash[order][:-1]) & (w.doc[order][1:] == w.doc[order][:-1]))[: len(w)]
        gap = np.maximum(np.diff(order, prepend=0), 1)
        level = np.where(again, np.minimum(np.log2(gap).astype(np.int64), GAPS - 2), GAPS - 1)
        gaps = np.bincount(w.doc[order] * GAPS + level, minlength=n * GAPS).reshape(n, GAPS)
        shares = gaps / np.maximum(np.diff(w.first), 1)[:, None]
        yield a, counts.astype(np.float32), shares.astype(np.float32), np.diff(w.first) > 0


def _directions(counts: np.ndarray, shares: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts) * rarity
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)
    return np.concatenate([weighted, np.sqrt(shares)], axis=1)


def _projected(rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
    out = rows @ axes
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def rarity(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of the terms, over all rows."""

    def count(batches):
        seen, rows = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, counts, _, _ in _blocks(batch.column("text")):
                seen += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([seen.tolist()], pa.list_(pa.int64())), pa.array([rows], pa.int64())], ["seen", "n"])

    per_task = docs.select("text").mapInArrow(count, "seen array<long>, n long")
    # One row per task is combined by term; the driver gets the fixed number of terms.
    sums = per_task.select(F.posexplode("seen").alias("term", "k"), "n").groupBy("term").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).collect()
    out = np.ones(TERMS, np.float32)
    for row in sums:
        out[row.term] = np.log((1 + row.n) / (1 + row.k)) + 1
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Space:
    """The space and the labelled vectors, from ``docs`` (doc_id, text) and ``labels`` (doc_id, label)."""
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    picks = known.orderBy(F.xxhash64(F.lit(83), "doc_id"), "doc_id").limit(labelled)
    # One text per id, however often the table repeats it, so that the driver gets ``labelled`` rows at most.
    chosen = docs.select("doc_id", "text").join(F.broadcast(picks), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def terms(batches):
        for batch in batches:
            ids, own = batch.column("doc_id"), batch.column("label").to_numpy()
            for a, counts, shares, _ in _blocks(batch.column("text")):
                packed = [np.concatenate([c, s]).astype(np.float32).tobytes() for c, s in zip(counts, shares, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(packed)), pa.array(own[a : a + len(packed)], pa.int32()), pa.array(packed)], ["doc_id", "label", "terms"])

    weights = rarity(docs)
    rows = chosen.select("doc_id", F.col("label").cast("int").alias("label"), "text").mapInArrow(terms, "doc_id long, label int, terms binary").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.label, r.terms))[:labelled]
    width = TERMS + GAPS
    if not rows:
        return Space(weights, np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
    matrix = np.frombuffer(b"".join(bytes(r.terms) for r in rows), np.float32).reshape(-1, width)
    matrix = _directions(matrix[:, :TERMS], matrix[:, TERMS:], weights)
    _, axes = np.linalg.eigh(matrix.T.astype(np.float64) @ matrix)
    axes = np.ascontiguousarray(axes[:, ::-1][:, :DIMENSIONS], np.float32)
    return Space(weights, axes, _projected(matrix, axes), np.array([r.label > 0 for r in rows], np.float32))


def votes(near: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Scores from cosines (texts x labelled rows)."""
    k = min(VOTES, near.shape[1])
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(near, top, 1).min(axis=1, keepdims=True)
    # Several rows as near as the last that votes: the first of them do.
    for row in np.flatnonzero((near >= least).sum(axis=1) > k):
        above, equal = np.flatnonzero(near[row] > least[row]), np.flatnonzero(near[row] == least[row])
        top[row] = np.concatenate([above, equal[: k - len(above)]])
    weight = np.maximum(np.take_along_axis(near, top, 1), 0) ** SHARPNESS
    total = weight.sum(axis=1)
    return np.where(total > 1e-12, (weight * labels[top]).sum(axis=1) / np.maximum(total, 1e-12), labels.mean())


def score(docs: DataFrame, space: Space) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def scored(batches):
        s = shared.value
        for batch in batches:
            for a, counts, shares, full in _blocks(batch.column("text")):
                if len(s.labels):
                    near = _projected(_directions(counts, shares, s.rarity), s.axes) @ s.vectors.T
                    near[~full] = 0
                    found = np.clip(votes(near, s.labels), 0, 1)
                else:
                    found = np.full(len(full), 0.5)
                ids = batch.column("doc_id").slice(a, len(full)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(found.astype(np.float64))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")


shipped(__name__)
