"""Benchmark decontamination by SimHash over item-sized windows.

Texts are cut to words (white space and ASCII punctuation part them, A-Z count
as a-z) and weighted five-word shingles; a shingle that few benchmark items
hold weighs more.  For every item length, each window of a document with that
many words has a 128-bit SimHash of its weighted shingles.  The items' hashes
are indexed by ``PARTS`` blocks of 8 bits, each under its own value and the
values one bit away.  Two hashes within ``RADIUS`` = 2 * PARTS - 1 bits agree
in some block up to one bit, so the index returns every such item.  Windows
and items found that way are then compared exactly: shared weight over joint
weight, at least ``share``.

A window whose shingles in common with all items weigh too little to reach
``share`` with any item of its length cannot match, so it is not hashed; this
bound loses nothing.  Items go to workers in parts of at most ``PART_BYTES`` of
text, one pass over the documents per part.  Weights follow the whole
benchmark, so results do not depend on the parts: with several of them, Spark
counts the items of every shingle, and each part also has the weights of the
other shingles that two items or more hold, at 12 bytes each.

Defined results: one row per document and item that match, with the window of
the highest similarity, the first of equals; null, empty and blank texts and
items match nothing; a text or item of fewer than five words is one shingle;
documents shorter than an item are one window; repeated rows match row by row;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import mix, runs, shingles, shipped, tables, words

SIZE = 5
PARTS = 16
RADIUS = 2 * PARTS - 1
PART_BYTES = 16 << 20
#: Characters that part words besides white space.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bits of the table that rules out shingles of no item.
SIEVE = 22


@dataclass
class Length:
    """The items of one length in words, with the block index of their hashes."""

    shingles: int
    need: float  #: least weight a window must share with the benchmark to match one of them
    items: np.ndarray
    prints: np.ndarray  #: items x PARTS bytes
    first: list[np.ndarray] = field(default_factory=list)  #: per block: bounds by value
    found: list[np.ndarray] = field(default_factory=list)  #: per block: places in ``items``


@dataclass
class Index:
    ids: list
    sets: list[dict[int, int]]  #: weight of each distinct shingle times its count, by item
    known: np.ndarray  #: all shingles, ascending
    weight: np.ndarray
    rare: int  #: weight of a shingle that no item has
    sieve: np.ndarray
    lengths: dict[int, Length]
    others: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  #: shingles of other parts that weigh less than ``rare``, ascending
    other_weight: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))


def _bits(hashes: np.ndarray) -> np.ndarray:
    """128 bits of every shingle, as rows of 0 and 1."""
    both = np.stack([mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)), mix(hashes + np.uint64(0x1B873593CC9E2D51))], axis=1)
    return np.unpackbits(np.ascontiguousarray(both).view(np.uint8), axis=1)


def _prints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


def _of(texts: pa.Array):
    """Word counts and shingle hashes of every text."""
    t = tables(also_apart=PUNCTUATION)
    for a, b, data, bounds in runs(texts):
        w = words(data, bounds, t)
        hashes, cut = shingles(w, SIZE)
        n = np.diff(w.first)
        for k in range(b - a):
            yield a + k, int(n[k]), hashes[cut[k] : cut[k + 1]]


def _weights(total: int, df: np.ndarray) -> np.ndarray:
    return np.rint(16 * np.log2(1 + total / np.maximum(df, 1))).astype(np.int64)


def index(ids: list, texts: list[str | None], share: tuple[int, int], whole: tuple[int, np.ndarray, np.ndarray] | None = None) -> Index:
    """The index of a bounded list of items.

    ``whole``: of the benchmark that they are a part of, the number of items
    with words, and the shingles of two items or more with their counts.
    """
    items = [(i, n, h) for i, n, h in _of(pa.array(texts, pa.string())) if len(h)]
    known, df = np.unique(np.concatenate([np.unique(h) for _, _, h in items] or [np.empty(0, np.uint64)]), return_counts=True)
    total, others = max(len(items), 1), {}
    if whole:
        total, common, counts = whole
        foreign = ~np.isin(common, known)
        others = {"others": common[foreign], "other_weight": _weights(total, counts[foreign]).astype(np.int32)}
        df = np.ones(len(known), np.int64)
        df[np.searchsorted(known, common[~foreign])] = counts[~foreign]
    weight = _weights(total, df)
    out = Index([ids[i] for i, _, _ in items], [], known, weight, int(np.rint(16 * np.log2(1 + total))), np.zeros(1 << SIEVE, bool), {}, **others)
    out.sieve[known & np.uint64((1 << SIEVE) - 1)] = True
    prints, sums = [], []
    for _, _, h in items:
        own = weight[np.searchsorted(known, h)]
        bag: dict[int, int] = {}
        for x, w in zip(h.tolist(), own.tolist(), strict=True):
            bag[x] = bag.get(x, 0) + w
        out.sets.append(bag)
        sums.append(sum(bag.values()))
        prints.append(_prints(((_bits(h).astype(np.int64) * 2 - 1) * own[:, None]).sum(axis=0, keepdims=True))[0])
    by_length: dict[int, list[int]] = {}
    for k, (_, n, _) in enumerate(items):
        by_length.setdefault(n, []).append(k)
    near = np.concatenate([[0], 1 << np.arange(8)]).astype(np.uint8)
    for n, own in sorted(by_length.items()):
        one = Length(max(n - SIZE + 1, 1), share[0] / share[1] * min(sums[k] for k in own), np.array(own), np.array([prints[k] for k in own]))
        for part in range(PARTS):
            values = (one.prints[:, part, None] ^ near).astype(np.int64)
            order = np.argsort(values.ravel(), kind="stable")
            one.first.append(np.searchsorted(values.ravel()[order], np.arange(257)))
            one.found.append(np.repeat(np.arange(len(own)), len(near))[order])
        out.lengths[n] = one
    return out


def within(one: Length, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a window and an item at most ``RADIUS`` bits apart: row of ``prints``, place in ``one.items``, distance."""
    rows, places = [], []
    for part in range(PARTS):
        first, value = one.first[part], prints[:, part].astype(np.int64)
        n = first[value + 1] - first[value]
        rows.append(np.repeat(np.arange(len(prints)), n))
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[value], n)
        places.append(one.found[part][at])
    pairs = np.unique(np.concatenate(rows) * len(one.items) + np.concatenate(places))
    row, place = pairs // len(one.items), pairs % len(one.items)
    far = np.bitwise_count(prints[row] ^ one.prints[place]).sum(axis=1)
    good = far <= RADIUS
    return row[good], place[good], far[good]


def _suspects(texts: pa.Array, ix: Index):
    """Texts with enough shingles of items: row, word count, hashes, and the places and weights of the shared shingles."""
    t = tables(also_apart=PUNCTUATION)
    least = min((one.need for one in ix.lengths.values()), default=0)
    for a, _, data, bounds in runs(texts):
        w = words(data, bounds, t)
        hashes, cut = shingles(w, SIZE)
        at = np.flatnonzero(ix.sieve[hashes & np.uint64((1 << SIEVE) - 1)])
        place = np.minimum(np.searchsorted(ix.known, hashes[at]), len(ix.known) - 1)
        hit = ix.known[place] == hashes[at]
        at, own = at[hit], ix.weight[place[hit]]
        edges = np.searchsorted(at, cut)
        sums = np.concatenate([[0], np.cumsum(own)])[edges]
        n = np.diff(w.first)
        for k in np.flatnonzero(np.diff(sums) >= max(least, 1)).tolist():
            lo, hi = edges[k], edges[k + 1]
            yield a + k, int(n[k]), hashes[cut[k] : cut[k + 1]], at[lo:hi] - cut[k], own[lo:hi]


def matches_of(texts: list[tuple], ix: Index, share: tuple[int, int]) -> list[tuple]:
    """``(row, item, shared weight, joint weight, distance, first word, words)`` of every item that a text holds.

    ``texts``: what :func:`_suspects` gives for a batch; the windows of one
    length are looked up together.
    """
    weights, windows = [], {length: [] for length in ix.lengths}
    for k, (_, _, hashes, at, own) in enumerate(texts):
        weight = np.full(len(hashes), ix.rare, np.int64)
        if len(ix.others):
            place = np.minimum(np.searchsorted(ix.others, hashes), len(ix.others) - 1)
            weight = np.where(ix.others[place] == hashes, ix.other_weight[place], weight)
        weight[at] = own
        weights.append(weight)
        common = np.zeros(len(hashes) + 1, np.int64)
        common[at + 1] = own
        common = np.cumsum(common)
        starts = {}
        for length, one in ix.lengths.items():
            m = min(one.shingles, len(hashes))
            start = np.flatnonzero(common[m:] - common[:-m] >= one.need)
            if len(start):
                starts[length] = (m, start)
        if not starts:
            continue
        low, high = min(x[0] for _, x in starts.values()), max(x[-1] + m for m, x in starts.values())
        sums = np.zeros((high - low + 1, 8 * PARTS), np.int32)
        np.cumsum((_bits(hashes[low:high]).astype(np.int32) * 2 - 1) * weight[low:high, None].astype(np.int32), axis=0, out=sums[1:])
        for length, (m, start) in starts.items():
            windows[length].append((k, start, _prints(sums[start + m - low] - sums[start - low])))
    best: dict[tuple[int, int], tuple] = {}
    for length, some in windows.items():
        if not some:
            continue
        one = ix.lengths[length]
        text = np.repeat([k for k, _, _ in some], [len(x) for _, x, _ in some])
        start = np.concatenate([x for _, x, _ in some])
        row, item, far = within(one, np.concatenate([x for _, _, x in some]))
        for t, r, k, d in zip(text[row].tolist(), start[row].tolist(), one.items[item].tolist(), far.tolist(), strict=True):
            i, n, hashes, _, _ = texts[t]
            m = min(one.shingles, len(hashes))
            bag: dict[int, int] = {}
            for x, w in zip(hashes[r : r + m].tolist(), weights[t][r : r + m].tolist(), strict=True):
                bag[x] = bag.get(x, 0) + w
            own = ix.sets[k]
            both = sum(min(w, own[x]) for x, w in bag.items() if x in own)
            joint = sum(bag.values()) + sum(own.values()) - both
            if share[1] * both >= share[0] * joint:
                old = best.get((t, k))
                if old is None or (both * old[3], -r) > (old[2] * joint, -old[5]):
                    best[t, k] = (i, k, both, joint, d, r, min(length, n))
    return [best[x] for x in sorted(best)]


MATCH = "doc_id long, item_id long, similarity double, distance int, first_word long, n_words long"


def _common(items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of items with words, and the shingles of two or more of them, ascending, with their counts."""

    def distinct(batches):
        for batch in batches:
            # One row per item without a hash counts the items.
            own = [np.unique(h).view(np.int64) for _, _, h in _of(batch.column("text")) if len(h)]
            hashes = pa.array(np.concatenate([*own, np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([hashes, pa.nulls(len(own), pa.int64())])], ["hash"])

    counts = items.select("text").mapInArrow(distinct, "hash long").groupBy("hash").count().where("hash IS NULL OR count > 1").toArrow()
    none = counts["hash"].is_null().to_numpy()
    df = counts["count"].to_numpy()
    hashes = counts.filter(pa.array(~none))["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return max(int(df[none].sum()), 1), hashes[order], df[~none][order]


def _indexes(benchmark: DataFrame, share: tuple[int, int]):
    """A broadcast index for every part of the benchmark."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    whole = _common(items) if parts > 1 else None
    for part in range(parts):
        # At most about PART_BYTES of item texts come to the driver at a time.
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        rows = sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        yield benchmark.sparkSession.sparkContext.broadcast(index([r.item_id for r in rows], [r.text for r in rows], share, whole))


def _matched(batch: pa.RecordBatch, ix: Index, share: tuple[int, int]) -> list[tuple]:
    return matches_of(list(_suspects(batch.column("text"), ix)), ix, share) if ix.ids else []


def matches(docs: DataFrame, benchmark: DataFrame, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """:data:`MATCH` rows of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text)."""
    out = None
    for shared in _indexes(benchmark, share):

        def search(batches, shared=shared):
            ix = shared.value
            for batch in batches:
                ids = batch.column("doc_id")
                found = [(ids[i].as_py(), ix.ids[k], both / joint, d, r, w) for i, k, both, joint, d, r, w in _matched(batch, ix, share)]
                columns = list(zip(*found, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
                names = ["doc_id", "item_id", "similarity", "distance", "first_word", "n_words"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        found = docs.select("doc_id", "text").mapInArrow(search, MATCH)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of ``docs`` (any columns, one of them ``text``) that match no item; a map, without a join."""
    for shared in _indexes(benchmark, share):

        def keep(batches, shared=shared):
            ix = shared.value
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[m[0] for m in _matched(batch, ix, share)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


shipped(__name__)
