"""Quality rules, line dedup, language and quality classes."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlespark.llm import language, lines, neighbours, quality, queries
from candlespark.llm.common import table

SMALL = "/root/testdata/sf0.001"


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}


def base(text):
    w = text.encode().split()
    seen, again, covered = set(), 0, set()
    for line in text.split("\n"):
        if line.encode().split():
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    for k in range(len(w) - 2):
        if windows[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered), failed


def test_base_counts(spark):
    texts = texts_of(spark)
    for r in queries.QUERIES["op1_quality_rules"](spark, SMALL).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_fences_are_exact_quartiles_of_cells(spark, make):
    """With few values the sketch is exact; a small group takes its language's fences."""
    clean = [" ".join(f"{chr(97 + (k * 7 + i) % 26)}{k}{i}z" for i in range(60 + k)) for k in range(40)]
    junk = " ".join("ab#$%" + str(i) for i in range(80))
    docs = make([*clean, junk, junk + " x"], source=["s"] * 40 + ["s", "tiny"])
    got = {r.doc_id: r.kept for r in quality.judge(docs, min_group=10).collect()}
    assert all(got[k] for k in range(40)) and not got[40] and not got[41]
    cells = spark.range(70).select(quality.cell(F.col("id") * 37).alias("c"), (F.col("id") * 37).alias("v")).collect()
    for r in cells:
        bits = max(r.v.bit_length() - quality.BITS, 0)
        assert r.c == r.v >> bits << bits


@pytest.mark.parametrize("run", [2, lines.RUN])
def test_line_dedup(spark, make, monkeypatch, run):
    """Also when the documents of one key lie in many runs."""
    monkeypatch.setattr(lines, "RUN", run)
    shared = "  This line is shared by very many documents, Truly."
    texts = [f"{shared}\nown line number {k} that is quite long enough to count" for k in range(6)]
    texts[2] += "\n" + shared.upper().replace("É", "é") + "\t"
    texts += [None, "", "short\nshort", "\n" * 200 + shared]
    docs = make(texts)
    got = {r.doc_id: r for r in lines.apply(docs, lines.keep_bitmaps(docs)).collect()}
    assert got[9].kept == texts[9] and got[9].n_dropped == 0 and got[9].n_lines == 201
    for k in range(6):
        assert got[k].kept == f"own line number {k} that is quite long enough to count"
        assert got[k].n_dropped == (2 if k == 2 else 1)
    assert (got[6].kept, got[6].n_lines) == ("", 1) and (got[7].kept, got[7].n_lines) == ("", 1)


def test_line_dedup_of_repeated_ids(spark, make):
    """Two texts of one id: neither loses a line because of where the other's lie."""
    shared = "this line is shared by very many documents, truly it is"
    own = "unique first line that nobody else has, and long enough to count"
    texts = [f"{shared}\n{own} {k}" for k in range(6)] + [f"{own} six\n{shared}", f"{shared}\n{own} seven", f"{shared}\n{own} seven", shared]
    docs = make(texts, ids=[0, 1, 2, 3, 4, 5, 5, 5, 5, None])
    rows = lines.apply(docs, lines.keep_bitmaps(docs)).collect()
    # The largest id keeps the line in all of its rows; a row without an id keeps everything.
    assert sorted((r.doc_id, r.kept) for r in rows if r.doc_id is not None and r.doc_id < 5) == [(k, f"{own} {k}") for k in range(5)]
    assert sorted(r.kept for r in rows if r.doc_id == 5) == sorted(texts[5:9]) and [r.kept for r in rows if r.doc_id is None] == [shared]
    docs = make(texts[5:9] + texts[:5] + [shared], ids=[0, 0, 0, 0, 1, 2, 3, 4, 6, 9])
    kept = sorted(r.kept for r in lines.apply(docs, lines.keep_bitmaps(docs)).collect() if r.doc_id == 0)
    assert kept == sorted([f"{own} 5", f"{own} six", f"{own} seven", f"{own} seven"])


def test_line_dedup_by_brute_force(spark):
    texts = texts_of(spark)
    white = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs_of = defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            docs_of[line.strip(white).translate(low)].add(i)
    for r in queries.QUERIES["op3_line_dedup"](spark, SMALL).collect():
        kept = []
        for line in texts[r.doc_id].split("\n"):
            key = line.strip(white).translate(low)
            if len(key) < 40 or len(docs_of[key]) < 5 or max(docs_of[key]) == r.doc_id:
                kept.append(line)
        assert r.kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_language_held_out(spark):
    got = queries.QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").where("held_out").select("doc_id", "lang_pred")
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    assert got.join(docs, "doc_id").where("lang = lang_pred").count() >= 0.97 * got.count()


def test_language_edges(spark, make):
    docs = make([None, "", "123 ...", "the cat and the dog", "der hund und die katze"], lang=["en", "en", "en", "en", "de"])
    known = language.dictionaries(docs.withColumn("learn", F.lit(True)))
    got = [(r.lang_pred, r.rejected) for r in language.predict(docs, known).orderBy("doc_id").collect()]
    assert got[:3] == [("und", True)] * 3 and got[3][0] == "en" and got[4][0] == "de"
    none = language.predict(docs, {}).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in none] == ["und"]


def test_quality_held_out(spark):
    got = queries.QUERIES["op8_quality_scores"](spark, "/root/testdata/sf0.01").where("held_out")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    both = got.join(labels, "doc_id").select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in both) >= 0.95 * len(both)


def test_quality_without_labels(spark, make):
    docs = make(["a b c", None])
    space = neighbours.fit(docs, spark.createDataFrame([], "doc_id long, label int"))
    assert [r.score for r in neighbours.score(docs, space).collect()] == [0.5, 0.5]


def test_votes_by_brute_force():
    """The nearest by cosine, of equals those that come first; weights grow with similarity."""
    rng = np.random.default_rng(4)
    labels = (rng.random(60) < 0.5).astype(np.float32)
    near = np.round(rng.random((200, 60)), 1).astype(np.float32)  # many ties
    for row, got in zip(near, neighbours.votes(near.copy(), labels)):
        top = sorted(range(60), key=lambda k: (-row[k], k))[: neighbours.VOTES]
        weight = np.array([row[k] for k in top], np.float64) ** neighbours.SHARPNESS
        assert got == pytest.approx((weight * labels[top]).sum() / weight.sum(), abs=1e-5)


def test_terms_of_texts():
    """Trigram counts and recurrence by gap, counted one by one."""
    import pyarrow as pa

    texts = ["one two one two two", "", "abc", "a a a a"]
    (at, counts, gaps, full), = neighbours._blocks(pa.array(texts))
    assert at == 0 and full.tolist() == [True, False, True, True]
    assert counts.sum(axis=1).tolist() == [max(len(t) - 2, 0) for t in texts]
    want = np.zeros((4, neighbours.GAPS), np.float32)
    for i, t in enumerate(texts):
        words, last = t.split(), {}
        for k, w in enumerate(words):
            want[i, min(int(np.log2(k - last[w])), neighbours.GAPS - 2) if w in last else neighbours.GAPS - 1] += 1 / len(words)
            last[w] = k
    assert np.allclose(gaps, want)


@pytest.mark.parametrize("frame", ["odd", "nothing"])
def test_odd_rows(spark, frame, request):
    docs = request.getfixturevalue(frame)
    n = docs.count()
    judged = quality.judge(docs).collect()
    assert len(judged) == n and all(r.base_failed and not r.kept for r in judged if not r.n_words)
    assert lines.apply(docs.select("doc_id", "text"), lines.keep_bitmaps(docs)).count() == n
    known = language.dictionaries(docs.drop("learn").withColumn("learn", F.lit(True)))
    assert language.predict(docs, known).count() == n
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS label")
    scores = [r.score for r in neighbours.score(docs, neighbours.fit(docs, labels)).collect()]
    assert len(scores) == n and all(0 <= s <= 1 for s in scores)
