"""Near-duplicate classes by HyperMinHash.

A document's set is its distinct word shingles.  Its sketch keeps, for each of
``BUCKETS`` buckets of the hash space, the least hash in compressed form: the
number of leading zeros and ``MANTISSA`` more bits, 16 bits in all.  Buckets
without a hash borrow from others in a fixed order, so short texts band too.

1. Texts with equal sets are one class; only its least id goes on.
2. Four registers form a band; documents that agree on a band share a bucket.
3. Hub round: a document is paired with one hub, the member that most documents
   of its buckets agree with.  Pairs are as many as documents, however large a
   group of copies is.  Pairs are verified on full sets and linked.
4. Rest: buckets whose members are by then in one component are done.  In the
   others every pair across components is estimated from the registers, with
   the expected register collisions taken out; pairs within ``SLACK`` of the
   threshold put their documents into one group.  Within a group all pairs are
   verified on full sets.  Large buckets and groups are cut into blocks, and
   tasks compare two blocks; they name one link per document, not all pairs.
5. Classes are the components of all verified links.

With 32 bands of 4 registers a pair of similarity 0.8 shares none with a
probability of about 5e-8.  Registers of one bucket and texts of one hub are
split over tasks by salt; no group is held by one task.

Defined results: null, empty and blank texts have the empty set and are linked
with nothing; ties go to the least id; rows that repeat an id are one document;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import mix, runs, saved, shingles, shipped, tables, words
from candlespark.llm.graph import components

BUCKETS = 128
MANTISSA = 10
ROWS = 4  #: registers of a band: four of 16 bits make its key
#: Pairs whose estimate lies this far below the threshold are ruled out: about four standard errors of 128 registers.
SLACK = 0.13
#: Members of a bucket in one block.
BLOCK = 1024
#: Partners of a hub that meet in one task.
HUB_BLOCK = 128
#: Rows of a matrix of pairs that are worked on at a time.
STRIPE = 128
#: Documents in one block where whole texts are compared.
TEXT_BLOCK = 128

SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, registers binary"


def _lookups() -> tuple[np.ndarray, np.ndarray]:
    """The least hash of each bucket, and the order in which an empty bucket asks others."""
    edges = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(57)
    tries = np.arange(4 * BUCKETS * BUCKETS, dtype=np.uint64).reshape(-1, BUCKETS)
    return edges, (mix(tries + np.uint64(977)) % np.uint64(BUCKETS)).astype(np.int64)


def registers(least: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the least hashes (documents x buckets); ``full`` tells which exist."""
    x = (least & np.uint64((1 << 57) - 1)) >> np.uint64(4)
    bits = np.frexp(x.astype(np.float64))[1].astype(np.uint64)
    zeros = np.uint64(53) - bits
    fraction = (x << (zeros + np.uint64(1))) & np.uint64((1 << 53) - 1)
    out = ((zeros << np.uint64(MANTISSA)) | (fraction >> np.uint64(53 - MANTISSA))).astype(np.uint16)
    _, tries = _lookups()
    done = full.copy()
    rows = np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
    for ask in tries:
        if not len(rows):
            break
        lends = ~done[rows] & full[rows][:, ask]
        out[rows] = np.where(lends, out[rows][:, ask], out[rows])
        done[rows] |= lends
        rows = rows[~done[rows].all(axis=1)]
    for row in rows:
        out[row, ~done[row]] = out[row, np.flatnonzero(full[row])[0]]
    return out


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The distinct shingles of every text, ascending, a few texts at a time."""
    t = tables()
    for a, b, data, bounds in runs(column):
        hashes, cut = shingles(words(data, bounds, t), size)
        yield a, [np.unique(hashes[cut[k] : cut[k + 1]]) for k in range(b - a)]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """The sketch of every row of ``docs`` (doc_id, text)."""

    def sketch(batches):
        edges, _ = _lookups()
        for batch in batches:
            for a, sets in _sets(batch.column("text"), size):
                least, full = np.zeros((len(sets), BUCKETS), np.uint64), np.zeros((len(sets), BUCKETS), bool)
                sums = np.zeros((2, len(sets)), np.uint64)
                for k, own in enumerate(sets):
                    if len(own):
                        at = np.minimum(np.searchsorted(own, edges), len(own) - 1)
                        least[k] = own[at]
                        full[k] = least[k] >> np.uint64(57) == np.arange(BUCKETS, dtype=np.uint64)
                        sums[0, k] = own.sum(dtype=np.uint64)
                        sums[1, k] = np.bitwise_xor.reduce(mix(own))
                regs = registers(least, full)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, len(sets)).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "s1", "s2", "registers"],
                )

    return docs.select("doc_id", "text").mapInArrow(sketch, SKETCH)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def band_keys(sketched: DataFrame) -> DataFrame:
    """``key, doc_id``: one row per document and band."""

    def keys(batches):
        for batch in batches:
            if batch.num_rows:
                bands = _matrix(batch.column("registers")).view(np.uint64)
                n = bands.shape[1]
                key = mix(bands + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                ids = np.repeat(batch.column("doc_id").to_numpy(), n)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids)], ["key", "doc_id"])

    return sketched.select("doc_id", "registers").mapInArrow(keys, "key long, doc_id long")


def estimate(same: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less the share that differing sets have in common by chance.

    Two independent registers are equal with a probability of about
    0.17 / 2**MANTISSA when the sets are equally large, and less otherwise.
    """
    chance = 0.16992 * 4 * na * nb / np.maximum(na + nb, 1) ** 2 / (1 << MANTISSA)
    return (same / BUCKETS - chance) / (1 - chance)


def _dealt(rows: DataFrame, size: int, *carry: str) -> DataFrame:
    """Each row of a group (``key``, ``n_members``) once for every pair of blocks it belongs to: ``key, i, j`` and ``carry``.

    A block has about ``size`` rows, so a cell (two blocks, or one) fits a task however large its group is.
    """
    blocks = F.ceil(F.col("n_members") / F.lit(size)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.col("blocks")).cast("int")
    placed = rows.withColumn("blocks", blocks).withColumn("own", own)
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("i"), F.greatest(b, F.col("own")).alias("j")))
    dealt = placed.withColumn("cell", F.explode(others)).select("key", "cell.i", "cell.j", "doc_id", *carry)
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id")


def _cells(batches) -> Iterator[pa.Table]:
    """The rows of a sorted partition in tables of whole cells."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks()
        names = [rows.column(c).to_numpy() for c in ("key", "i", "j")]
        begun = int(np.argmax(np.all([c == c[-1] for c in names], axis=0)))  # the last cell may go on
        if begun:
            yield rows.slice(0, begun).combine_chunks()
            held = rows.slice(begun).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _cuts(rows: pa.Table) -> np.ndarray:
    """Bounds of the cells in ``rows``."""
    names = [rows.column(c).to_numpy() for c in ("key", "i", "j")]
    fresh = np.any([c[1:] != c[:-1] for c in names], axis=0)
    return np.concatenate([[0], np.flatnonzero(fresh) + 1, [rows.num_rows]])


def _roots(near: np.ndarray) -> np.ndarray:
    """The first member of each member's component in a symmetric matrix of links."""
    label = np.arange(len(near), dtype=np.int32)
    far = np.int32(len(near))
    while True:
        low = label.copy()
        for at in range(0, len(near), STRIPE):
            part = slice(at, at + STRIPE)
            low[part] = np.minimum(low[part], np.where(near[part], label[None, :], far).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def estimated_groups(members: DataFrame, least: float) -> DataFrame:
    """``a, b``: links that join documents of different components whose estimate is at least ``least``.

    ``members``: key, n_members, doc_id, component, n_shingles, registers.  A
    cell names only one link per document, to the first of its group, so the
    rows made are as many as the rows read and not as the pairs compared.
    """

    def compare(batches):
        for rows in _cells(batches):
            ids, comp, n = (rows.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles"))
            regs, cut = _matrix(rows.column("registers")), _cuts(rows)
            left, right = [np.empty(0, int)], [np.empty(0, int)]
            twos = cut[:-1][np.diff(cut) == 2]
            same = (regs[twos] == regs[twos + 1]).sum(axis=1)
            good = (estimate(same, n[twos].astype(float), n[twos + 1].astype(float)) >= least) & (comp[twos] != comp[twos + 1])
            left.append(twos[good])
            right.append(twos[good] + 1)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b - a > 2:
                    own, size = np.ascontiguousarray(regs[a:b].T), n[a:b].astype(np.float32)
                    near = np.zeros((b - a, b - a), bool)
                    for low in range(0, b - a, STRIPE):
                        part = slice(low, low + STRIPE)
                        same = np.zeros((len(size[part]), b - a), np.uint8)
                        for register in own:
                            same += register[part, None] == register[None, :]
                        near[part] = estimate(same, size[part, None], size[None, :]) >= least
                        near[part] &= comp[a:b][part, None] != comp[None, a:b]
                    root = _roots(near)
                    at = np.flatnonzero(root != np.arange(b - a))
                    left.append(a + root[at])
                    right.append(a + at)
            x, y = ids[np.concatenate(left)], ids[np.concatenate(right)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return _dealt(members, BLOCK, "component", "n_shingles", "registers").mapInArrow(compare, "a long, b long").distinct()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over the shingles that two sets or more have."""
    g = len(sets)
    row = np.repeat(np.arange(g), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    keep, place = often[column], np.cumsum(often) - 1
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((g, g), np.float32)
    width = 1 << 13
    for low in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((g, width), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out


def exact_groups(grouped: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """``a, b``: links that join the documents of each group as their full sets do.

    ``grouped``: key, n_members, doc_id, text.  All pairs of a cell are
    compared on full sets; one link per document is returned.
    """

    def compare(batches):
        for rows in _cells(batches):
            ids, cut = rows.column("doc_id").to_numpy(), _cuts(rows)
            left, right = [], []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                sets = [s for _, some in _sets(rows.column("text").slice(a, b - a), size) for s in some]
                n = np.array([len(s) for s in sets], np.int64)
                both = shared_counts(sets).astype(np.int64) if b - a > 1 else np.zeros((1, 1), np.int64)
                near = (both > 0) & (share[1] * both >= share[0] * (n[:, None] + n[None, :] - both))
                root = _roots(near)
                at = np.flatnonzero(root != np.arange(b - a))
                left += ids[a + root[at]].tolist()
                right += ids[a + at].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right), pa.int64()), pa.array(np.maximum(left, right), pa.int64())], ["a", "b"])

    return _dealt(grouped, TEXT_BLOCK, "text").mapInArrow(compare, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` of ``pairs`` (hub, doc) whose full sets reach ``share[0] / share[1]``.

    A hub's text is sent once for every ``HUB_BLOCK`` partners, a partner's once per pair.
    """
    degree = pairs.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(HUB_BLOCK)).alias("salts"))
    salted = pairs.join(degree, "hub").select("hub", "doc", F.pmod(F.xxhash64("doc"), F.col("salts")).alias("salt"))
    hubs = degree.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    parts = salted.select(F.col("doc").alias("doc_id"), "hub", "salt", F.lit(1).alias("part")).unionByName(
        hubs.select(F.col("hub").alias("doc_id"), "hub", "salt", F.lit(0).alias("part"))
    )
    sent = texts.join(parts, "doc_id").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "part")

    def check(batches):
        hub, base = None, None
        for batch in batches:
            hubs, part, ids = (batch.column(c).to_numpy() for c in ("hub", "part", "doc_id"))
            good: list[tuple[int, int]] = []
            for a, sets in _sets(batch.column("text"), size):
                for k, own in enumerate(sets, a):
                    if part[k] == 0:
                        hub, base = hubs[k], own
                    elif hub == hubs[k]:
                        both = len(np.intersect1d(base, own, assume_unique=True))
                        if both and share[1] * both >= share[0] * (len(base) + len(own) - both):
                            good.append((int(hub), int(ids[k])))
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in good], pa.int64()), pa.array([max(p) for p in good], pa.int64())], ["a", "b"])

    return sent.select("hub", "part", "doc_id", "text").mapInArrow(check, "a long, b long").distinct()


def classes(docs: DataFrame, size: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    sketched = saved(sketches(docs, size), "sketches")
    some = sketched.where("n_shingles > 0")
    first = saved(some.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("first_id")), "equal-sets")
    single = some.join(first.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    banded = saved(band_keys(single), "bands")
    buckets = banded.groupBy("key").agg(F.count("*").alias("n_members"), F.bit_xor(F.xxhash64("doc_id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "doc_id")).alias("x2"))
    shared = saved(buckets.where("n_members > 1"), "buckets")
    members = saved(banded.join(shared.select("key", "n_members"), "key"), "members")
    texts = saved(docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    # Hub round.
    fame = members.groupBy("doc_id").agg(F.sum("n_members").alias("fame"))
    famous = members.join(fame, "doc_id").select("key", "doc_id", F.struct("fame", (-F.col("doc_id")).alias("less")).alias("rank"))
    hubs = famous.groupBy("key").agg(F.max("rank").alias("rank"))
    chosen = members.join(hubs, "key").groupBy("doc_id").agg(F.max("rank").alias("rank"))
    asked = chosen.select((-F.col("rank.less")).alias("hub"), F.col("doc_id").alias("doc")).where("hub <> doc")
    links = saved(verified(saved(asked, "hub-pairs"), texts, size, share), "links")

    # Pairs across the components so far.
    near = components(links)
    placed = members.join(near, F.col("doc_id") == F.col("id"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    # Bands often group the same documents; one bucket of each group is enough.
    apart = shared.join(mixed, "key", "left_semi").groupBy("n_members", "x1", "x2").agg(F.min("key").alias("key"))
    open_ = placed.join(apart.select("key", "n_members"), "key").join(single.select("doc_id", "n_shingles", "registers"), "doc_id")
    groups = components(estimated_groups(open_, share[0] / share[1] - SLACK)).withColumnRenamed("component", "key")
    sizes = groups.groupBy("key").agg(F.count("*").alias("n_members"))
    grouped = groups.join(sizes, "key").select("key", "n_members", F.col("id").alias("doc_id")).join(texts, "doc_id")
    more = saved(exact_groups(grouped, size, share), "links")
    final = components(links.unionByName(more))

    named = sketched.join(first, ["n_shingles", "s1", "s2"], "left").join(final, F.col("first_id") == F.col("id"), "left")
    component = F.coalesce("component", "first_id", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row of ``docs`` (any columns) for each class; rows without an id stay."""
    kept = classes(docs, size, share).where("kept AND doc_id IS NOT NULL").select("doc_id")
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id IS NULL"))


shipped(__name__)
