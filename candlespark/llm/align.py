"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and how usual each pair of tokens is.

Cuts are byte offsets where a token of both vocabularies ends.  The first cut
comes from the tokenizers' own spans (characters for the byte-level one, bytes
for the pieces); where a character is split between tokens, or a token is one
byte of a character, its end is refined by the bytes the token decodes to.

* **Words.** Every word is aligned once per task and looked up afterwards: no
  token spans the edges of a word, so every edge is a cut (``tokens.py``).
* **Counts.** A pair's count is the number of documents that hold it linked.
  Batches of documents keep their distinct pairs sorted; pairs are dealt by
  hash ranges, merged there, and each batch is answered once per pair it holds,
  so a usual pair costs one entry per batch, not one per document.
* **Edges.** A text that is null or empty, or that one of the vocabularies does
  not give back byte by byte, has no tokens: zeros and an empty string.  Each
  row is a document of its own, also when its doc_id or text repeats.  Ties for
  the highest count all count.  An empty table gives no rows.  Extra columns are
  ignored.  Texts are never cut; memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import mix, runs, saved, shipped
from candlespark.llm.tokens import BLOCK, CUT, FOLDER, REMEMBERED, ByteLevel, Pieces, content, sequences

BYTE_LEVEL, PIECES = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Bytes of text per batch of documents (a longer text makes a batch of its own).
BATCH = 8 << 20
#: Distinct pairs per hash range, at most and on average.
RANGE = 1 << 20
#: Groups of more token pairs are linked by their distinct ids.
PLAIN = 4096

ROW = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
ROW_DDL = "doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string"
TOKENS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def packed(x: np.ndarray) -> bytes:
    """Integers by byte plane, compressed: high bytes of small numbers take next to nothing."""
    return zstandard.compress(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1).astype(np.int64)


def steps(x: np.ndarray) -> bytes:
    """Sorted integers, as differences."""
    return packed(np.diff(x, prepend=0))


def walked(x: bytes) -> np.ndarray:
    return np.cumsum(unpacked(x))


def spread(n: np.ndarray) -> np.ndarray:
    """``0 .. n[i] - 1`` for each i in turn."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Aligner:
    """Words and how their tokens align; every word is worked out once."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        self.a, self.b = ByteLevel(byte_level), Pieces(pieces)
        self.span = self.a.size * self.b.size
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.odd: dict[str, int] = {}
        self.text: list[str | None] = []  #: the groups of a word; None: bytes are not given back
        self.counts: list[np.ndarray] = []  #: n_a, n_b, n_groups, n_links per word
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.n_keys: list[np.ndarray] = []

    def ends(self, joined: str) -> tuple | None:
        """Ids and end bytes of both sides for a text that begins with a space; None if bytes are not given back."""
        data = joined.encode()
        ids_a, low, high = self.a.spans(joined)
        if len(data) == len(joined):
            coarse = high
        else:
            first = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            coarse = np.append(first, len(data))[high]
        decoded = np.cumsum(self.a.length[ids_a])
        # A character that the next token also claims is split: its tokens end where their bytes do.
        end_a = np.where(np.append(low[1:] >= high[:-1], True), coarse, decoded)
        if not np.array_equal(end_a, decoded) or b"".join([self.a.bytes[i] for i in ids_a.tolist()]) != data:
            return None
        ids_b, end_b = self.b.spans(joined[1:])
        decoded = np.cumsum(self.b.length[ids_b])
        # Bytes of one character share its end; each ends where its byte does.
        end_b = np.where(self.b.fallback[ids_b], decoded, end_b + 1)
        if not np.array_equal(end_b, decoded) or b"".join([self.b.bytes[i] for i in ids_b.tolist()]) != data:
            return None
        return ids_a, end_a, ids_b, end_b

    def learn(self, words: list[str], odd: bool) -> None:
        """Work out new words, joined to blocks where they may stand side by side."""
        book = self.odd if odd else self.known
        block, size = [], 0
        for w in words:
            book[w] = len(book) + len(self.odd if book is self.known else self.known)
            alone = odd or not self.b.separable
            if block and (alone or size > BLOCK):
                self.block(block)
                block, size = [], 0
            block.append(w)
            size += len(w) + 1
            if alone:
                self.block(block)
                block, size = [], 0
        if block:
            self.block(block)

    def block(self, words: list[str]) -> None:
        found = self.ends("".join([" " + w for w in words]))
        edges = np.cumsum([len(w.encode()) + 1 for w in words])
        if found is not None and not (np.isin(edges, found[1]).all() and np.isin(edges, found[3]).all()):
            found = None
        if found is None and len(words) > 1:
            half = len(words) // 2
            self.block(words[:half])
            self.block(words[half:])
            return
        if found is None:
            self.text.append(None)
            self.counts.append(np.zeros((1, 4), np.int64))
            self.n_keys.append(np.zeros(1, np.int64))
            return
        ids_a, end_a, ids_b, end_b = found
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        word = np.searchsorted(edges, cuts)  # of each group
        n = len(words)
        links = in_a * in_b
        per = [np.bincount(word, w, n).astype(np.int64) for w in (in_a, in_b, np.ones(len(cuts)), links)]
        self.counts.append(np.stack(per, 1))
        key, owner, times = self.linked(ids_a, ids_b, in_a, in_b, word)
        # Distinct pairs per word with how often each is linked.
        both = owner * self.span + key
        order = np.argsort(both, kind="stable")
        both, key, owner, times = both[order], key[order], owner[order], times[order]
        at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        self.keys.append(key[at])
        self.times.append(np.add.reduceat(times, at))
        self.n_keys.append(np.bincount(owner[at], minlength=n))
        self.text += self.written(ids_a.tolist(), ids_b.tolist(), in_a.tolist(), in_b.tolist(), np.bincount(word, minlength=n).tolist())

    def linked(self, ids_a, ids_b, in_a, in_b, word):
        """Pairs of each group as (key, word, times); large groups by distinct ids, so that they never unfold."""
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        plain = np.flatnonzero(in_a * in_b <= PLAIN)
        links = (in_a * in_b)[plain]
        g, k = np.repeat(plain, links), spread(links)
        key = ids_a[first_a[g] + k // in_b[g]] * self.b.size + ids_b[first_b[g] + k % in_b[g]]
        keys, owners, times = [key], [word[g]], [np.ones(len(key), np.int64)]
        for g in np.flatnonzero(in_a * in_b > PLAIN).tolist():
            a, n_a = np.unique(ids_a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            b, n_b = np.unique(ids_b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            keys.append((a[:, None] * self.b.size + b).ravel())
            owners.append(np.full(len(a) * len(b), word[g]))
            times.append((n_a[:, None] * n_b).ravel())
        return np.concatenate(keys), np.concatenate(owners), np.concatenate(times)

    @staticmethod
    def written(ids_a, ids_b, in_a, in_b, groups) -> list[str]:
        """``a1,a2|b1;a3|b2`` per word."""
        a, b = [str(i) for i in ids_a], [str(i) for i in ids_b]
        out, i, j, g = [], 0, 0, 0
        for n in groups:
            parts = []
            for g in range(g, g + n):
                x, y = in_a[g], in_b[g]
                parts.append(f"{a[i]}|{b[j]}" if x == y == 1 else ",".join(a[i : i + x]) + "|" + ",".join(b[j : j + y]))
                i, j = i + x, j + y
            g += 1
            out.append(";".join(parts))
        return out

    def look_up(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's words."""
        if len(self.text) > REMEMBERED:
            self.forget()
        known, out, uneven = self.known, [], {}
        words = [t.split(" ") if t else [] for t in texts]
        fresh = {w for ws in words for w in ws if w not in known}
        rough = {w for w in fresh if not w or w[0].isspace() or w[-1].isspace()}
        if rough or not self.b.separable:
            for k, ws in enumerate(words):
                if ws and (not self.b.separable or not rough.isdisjoint(ws)):
                    uneven[k] = [w[1:] for w in CUT.split(" " + texts[k])] if self.b.separable else [texts[k]]
            # Words of such texts that stand by themselves elsewhere, too, are learnt with the others.
            fresh = {w for k, ws in enumerate(words) if k not in uneven for w in ws if w not in known}
        self.learn(sorted(fresh), False)
        self.learn(sorted({w for ws in uneven.values() for w in ws if w not in self.odd}), True)
        for k, ws in enumerate(words):
            book = self.odd if k in uneven else known
            ws = uneven.get(k, ws)
            out.append(np.fromiter(map(book.__getitem__, ws), np.int64, len(ws)))
        return out

    def arrays(self):
        """The words' counts, key bounds, keys and times, as one array each."""
        counts = np.concatenate([np.zeros((0, 4), np.int64), *self.counts])
        n_keys = np.concatenate([np.zeros(0, np.int64), *self.n_keys])
        keys, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.keys, self.times))
        self.counts, self.n_keys, self.keys, self.times = [counts], [n_keys], [keys], [times]
        return counts, n_keys, np.cumsum(n_keys) - n_keys, keys, times


def _documents(aligner: Aligner, texts: list[str]):
    """Per text: n_a, n_b, n_groups, n_links and the digest; and (text, key, times) of all distinct pairs, sorted."""
    words = aligner.look_up(texts)
    counts, n_keys, first, keys, times = aligner.arrays()
    n = len(texts)
    totals, digests = np.zeros((n, 4), np.int64), [""] * n
    for k, ws in enumerate(words):
        groups = [aligner.text[w] for w in ws.tolist()]
        if not groups or None in groups:
            words[k] = ws[:0]
            continue
        totals[k] = counts[ws].sum(0)
        digests[k] = sha256(";".join(groups).encode()).hexdigest()
    doc = np.repeat(np.arange(n), [len(w) for w in words])
    word = np.concatenate([np.zeros(0, np.int64), *words])
    spot, often = np.unique(doc * max(len(n_keys), 1) + word, return_counts=True)
    doc, word = spot // max(len(n_keys), 1), spot % max(len(n_keys), 1)
    per = n_keys[word] if len(word) else np.zeros(0, np.int64)
    at = np.repeat(first[word], per) + spread(per) if len(word) else per
    doc, key, count = np.repeat(doc, per), keys[at], times[at] * np.repeat(often, per)
    both = doc * aligner.span + key
    order = np.argsort(both, kind="stable")
    both, doc, key, count = both[order], doc[order], key[order], count[order]
    new = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(doc) else np.zeros(0, np.int64)
    return totals, digests, doc[new], key[new], (np.add.reduceat(count, new) if len(new) else count)


def batches_of(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """Documents aligned, some MB at a time: one row per batch with its documents and its distinct pairs.

    ``keys``, ``docs``: the pairs and how many of the batch's documents hold each.
    ``doc``, ``pair``, ``times``: for each document (by place) its pairs (by place in ``keys``) and how often each is linked.
    """
    spark = docs.sparkSession
    spec, model = content(spark, byte_level), content(spark, pieces)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(spec, model)
        rows, held, size = [], [], 0

        def batch():
            ids, totals = np.concatenate([r[0] for r in rows]), np.concatenate([r[2] for r in rows])
            valid = np.concatenate([r[1] for r in rows])
            digests = [d for r in rows for d in r[3]]
            starts = np.cumsum([0, *[len(r[0]) for r in rows]])
            doc = np.concatenate([h[0] + s for h, s in zip(held, starts)])
            every, times = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            keys, pair, n = np.unique(every, return_inverse=True, return_counts=True)
            fields = [pa.array(ids, mask=~valid), *[pa.array(totals[:, k]) for k in range(4)], pa.array(digests)]
            struct = pa.StructArray.from_arrays(fields, fields=list(ROW))
            # Places of one document follow each other in order: differences are small.
            step = np.diff(pair, prepend=0)
            fresh = np.append(True, doc[1:] != doc[:-1])[: len(step)]
            step[fresh] = pair[fresh]
            per = np.bincount(doc, minlength=len(ids))
            lists = pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct)
            binary = [packed(per), packed(step), packed(times), steps(keys), packed(n)]
            return pa.RecordBatch.from_arrays([lists, *[pa.array([x], pa.binary()) for x in binary], pa.array([len(keys)], pa.int64())],
                                              names=["rows", "doc", "pair", "times", "keys", "docs", "n_keys"])

        for b in batches:
            for low, high, data, bounds in runs(b["text"]):
                raw = data.tobytes()
                totals, digests, doc, key, times = _documents(aligner, [raw[x:y].decode() for x, y in zip(bounds, bounds[1:])])
                ids = b["doc_id"].slice(low, high - low)
                rows.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), totals, digests))
                held.append((doc, key, times))
                size += len(raw)
                if size >= BATCH or sum(len(r[0]) for r in rows) >= 1 << 16:
                    yield batch()
                    rows, held, size = [], [], 0
        if rows:
            yield batch()

    schema = f"rows array<struct<{ROW_DDL}>>, doc binary, pair binary, times binary, keys binary, docs binary, n_keys long"
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(aligned, schema)
    return out.withColumn("batch", F.monotonically_increasing_id())


def _dealt(batches: DataFrame, ranges: int) -> DataFrame:
    """(range, batch, keys, docs): the pairs of each batch by hash range, in order."""

    def dealt(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                keys, docs = walked(row["keys"]), unpacked(row["docs"])
                part = (mix(keys.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                ends = np.flatnonzero(np.diff(part[order])) + 1
                groups = [g for g in np.split(order, ends) if len(g)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part[g[0]] for g in groups], pa.int64()), pa.array([row["batch"]] * len(groups), pa.int64()),
                    pa.array([steps(keys[g]) for g in groups], pa.binary()), pa.array([packed(docs[g]) for g in groups], pa.binary()),
                ], names=["range", "batch", "keys", "docs"])

    return batches.select("batch", "keys", "docs").mapInArrow(dealt, "range long, batch long, keys binary, docs binary")


def pair_counts(batches: DataFrame, ranges: int) -> DataFrame:
    """(range, keys, counts): documents per pair, sorted by pair."""

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blocks in sequences(rows, "range"):
            keys, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
            for block in _ended(blocks):
                if block is not None:
                    waiting.append((walked(block["keys"]), unpacked(block["docs"])))
                    size += len(waiting[-1][0])
                if waiting and (block is None or size > RANGE):
                    every = np.concatenate([keys, *[w[0] for w in waiting]])
                    every_n = np.concatenate([counts, *[w[1] for w in waiting]])
                    order = np.argsort(every, kind="stable")
                    every, every_n = every[order], every_n[order]
                    at = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
                    keys, counts, waiting, size = every[at], np.add.reduceat(every_n, at), [], 0
            values = [part, steps(keys), packed(counts)]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, (pa.int64(), pa.binary(), pa.binary()))], names=["range", "keys", "counts"])

    blocks = _dealt(batches, ranges).select("range", "keys", "docs")
    return blocks.repartition("range").sortWithinPartitions("range").mapInArrow(counted, "range long, keys binary, counts binary")


def _ended(items):
    """The items, then None."""
    yield from items
    yield None


def pairs(counts: DataFrame, size_b: int) -> DataFrame:
    """(a, b, n_docs): the counts of :func:`pair_counts` as a table."""

    def table(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                keys = walked(row["keys"])
                yield pa.RecordBatch.from_arrays([pa.array(keys // size_b), pa.array(keys % size_b), pa.array(unpacked(row["counts"]))], names=["a", "b", "n_docs"])

    return counts.mapInArrow(table, "a long, b long, n_docs long")


def _answers(batches: DataFrame, counts: DataFrame, ranges: int) -> DataFrame:
    """(batch, range, counts): the corpus-wide count of every pair of a batch, in the order of its keys within the range."""

    def answered(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blocks in sequences(rows, "range"):
            held = next(blocks)
            keys, n = walked(held["keys"]), unpacked(held["docs"])
            for block in blocks:
                found = n[np.searchsorted(keys, walked(block["keys"]))]
                yield pa.RecordBatch.from_arrays([pa.array([block["batch"]]), pa.array([part]), pa.array([packed(found)], pa.binary())], names=["batch", "range", "counts"])

    first = counts.select("range", F.lit(None).cast("long").alias("batch"), "keys", F.col("counts").alias("docs"))
    blocks = first.unionByName(_dealt(batches, ranges).withColumn("docs", F.lit(None).cast("binary")))
    blocks = blocks.repartition("range").sortWithinPartitions("range", F.col("batch").asc_nulls_first())
    return blocks.mapInArrow(answered, "batch long, range long, counts binary")


def align(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces_model: str = PIECES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best``: links whose count is the highest of their byte-level id;
    ``count_sum``: the counts of all links.
    """
    batches = saved(batches_of(docs, byte_level, pieces_model), "aligned")
    entries = batches.agg(F.sum("n_keys").alias("n")).first().n or 0
    ranges = max(1, -(-entries // RANGE))
    counts = saved(pair_counts(batches, ranges), "pair-counts")
    size_b = Pieces(content(docs.sparkSession, pieces_model)).size
    # One row per id of the vocabulary at most, whatever the corpus.
    best = pairs(counts, size_b).groupBy("a").agg(F.max("n_docs").alias("most")).toArrow()
    most = np.zeros(int(max(best["a"].to_pylist(), default=0)) + 1, np.int64)
    most[best["a"].to_numpy()] = best["most"].to_numpy()

    def finished(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in sequences(rows, "batch"):
            found: dict[int, np.ndarray] = {}
            for row in parts:
                if row["rows"] is None:
                    found[row["range"]] = unpacked(row["counts"])
                    continue
                keys = walked(row["keys"])
                part = (mix(keys.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                n = np.zeros(len(keys), np.int64)
                if len(keys):
                    n[order] = np.concatenate([found[r] for r in sorted(found)])
                per, pair, times = unpacked(row["doc"]), unpacked(row["pair"]), unpacked(row["times"])
                doc = np.repeat(np.arange(len(per)), per)
                # Differences start anew with every document.
                total = np.cumsum(pair)
                before = np.append(0, total)[np.cumsum(per) - per]
                pair = total - np.repeat(before, per)
                best = n == most[keys // size_b] if len(keys) else np.zeros(0, bool)
                out = pa.array(row["rows"], pa.list_(ROW).value_type)
                sums = [_summed(doc, times * best[pair], len(per)), _summed(doc, times * n[pair], len(per))]
                columns = [out.field(k) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(s) for s in sums], out.field(5)], names=["doc_id", *TOKENS, "groups_sha256"])

    nothing = {c: F.lit(None).cast(batches.schema[c].dataType).alias(c) for c in ("rows", "doc", "pair", "times", "keys")}
    answers = _answers(batches, counts, ranges).select("batch", "range", "counts", *nothing.values())
    bodies = batches.select("batch", F.lit(None).cast("long").alias("range"), F.lit(None).cast("binary").alias("counts"), *nothing)
    both = answers.unionByName(bodies).repartition("batch").sortWithinPartitions("batch", F.col("range").asc_nulls_last())
    return both.mapInArrow(finished, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _summed(doc: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of ``x`` per document; documents come in order."""
    total = np.append(0, np.cumsum(x))
    edges = np.searchsorted(doc, np.arange(n + 1))
    return total[edges[1:]] - total[edges[:-1]]


def groups(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces_model: str = PIECES) -> DataFrame:
    """(doc_id, groups): the aligned groups of every document with the byte span of each in space + text and its ids.

    The spans of a document are one row; a document without tokens has none.
    """
    spark = docs.sparkSession
    spec, model = content(spark, byte_level), content(spark, pieces_model)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(spec, model)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                out, at = [], 0
                for w in CUT.split(" " + text) if text else []:
                    found = aligner.ends(w)
                    if found is None:
                        out = []
                        break
                    ids_a, end_a, ids_b, end_b = found
                    low = 0
                    for cut in np.intersect1d(end_a, end_b).tolist():
                        a, b = (i[(e > low) & (e <= cut)].tolist() for i, e in ((ids_a, end_a), (ids_b, end_b)))
                        out.append({"start": at + low, "end": at + cut, "a": a, "b": b})
                        low = cut
                    at += len(w.encode())
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([out], kind)], names=["doc_id", "groups"])

    schema = "doc_id long, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(spans, schema)


shipped(__name__)
