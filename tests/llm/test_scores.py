"""Kneser-Ney model, page extraction, mixing, and the pipeline as a whole."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from candlespark.llm import html_text, kneser_ney, mixing, queries
from candlespark.llm.common import table

SMALL = "/root/testdata/sf0.001"
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*(text or "").encode().translate(LOW).split(), "end"]


def brute_scores(texts, learned, order=kneser_ney.ORDER):
    """Counts of whole tuples of words; a text begins with order - 1 begin marks."""
    marks = ["begin"] * (order - 1)
    counts = {order: Counter()}
    single = Counter()
    for t in learned:
        words = marks + tokens(t)
        counts[order].update(tuple(words[i : i + order]) for i in range(len(tokens(t))))
        single.update(tokens(t))
    for k in range(order - 1, 0, -1):  # distinct longer grams that end so
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    n, v = sum(single.values()), len(single)
    off = {k: kneser_ney.discounts([Counter(c.values())[i] for i in (1, 2, 3, 4)]) for k, c in counts.items()}
    context, follow = Counter(), defaultdict(lambda: [0, 0, 0])
    for c in counts.values():
        for g, m in c.items():
            context[g[:-1]] += m
            follow[g[:-1]][min(m, 3) - 1] += 1

    def p(gram):
        if not gram:
            return 1 / (v + 1)
        k, before = len(gram), gram[:-1]
        if not context[before]:
            return p(gram[1:])
        m = counts[k][gram]
        left = sum(x * y for x, y in zip(off[k], follow[before], strict=True)) / context[before]
        return max(m - (off[k][min(m, 3) - 1] if m else 0), 0) / context[before] + left * p(gram[1:])

    out = []
    for t in texts:
        words = marks + tokens(t)
        total = sum(math.log10(p(tuple(words[i : i + order]))) for i in range(len(tokens(t))))
        plain = sum(math.log10((single[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        known = sum(single[w] > 0 for w in tokens(t))
        out.append((len(tokens(t)), known, n, pytest.approx(plain, rel=1e-9), pytest.approx(total, rel=1e-9)))
    return out


def test_scores_by_brute_force(spark):
    rows = table(spark, SMALL, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    held = [zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows]
    want = brute_scores([r.text for r in rows], [r.text for r, h in zip(rows, held, strict=True) if not h])
    got = queries.QUERIES["op2_lm_scores"](spark, SMALL).orderBy("doc_id").collect()
    assert [g.held_out for g in got] == held
    assert [(g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score) for g in got] == want
    # On held-out text the model beats the smoothed word frequencies.
    assert sum(g.score for g in got if g.held_out) > sum(g.base_score for g in got if g.held_out)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_of_any_order(spark, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "RANGE_BYTES", 50_000)
    monkeypatch.setattr(kneser_ney, "WIDE", 5)
    docs = table(spark, SMALL, "documents").select("doc_id", "text", (F.col("doc_id") % 4 != 1).alias("learn")).orderBy("doc_id").limit(60)
    rows = docs.collect()
    want = brute_scores([r.text for r in rows], [r.text for r in rows if r.learn], order)
    got = kneser_ney.score(docs, kneser_ney.train(docs, order=order)).orderBy("doc_id").collect()
    assert [(g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score) for g in got] == want


def test_counts_beyond_a_byte(tmp_path):
    """Every count comes back, whatever its size; absent keys are 0."""
    keys = np.arange(10, 5010, 5, dtype=np.uint64)
    counts = np.random.default_rng(1).integers(0, 300, (len(keys), 6))
    counts[7, 3], counts[8, 0] = 1 << 33, 254
    kneser_ney._put_rows(f"{tmp_path}/rows", keys, counts)
    asked = np.arange(5000, dtype=np.uint64)
    out = np.zeros((6, len(asked)))
    kneser_ney.Rows(kneser_ney._map(f"{tmp_path}/rows"), 6).find(asked, list(range(6)), out)
    want = np.zeros((6, len(asked)))
    want[:, keys[keys < 5000].astype(int)] = counts[keys < 5000].T
    assert (out == want).all()


@pytest.mark.parametrize("frame", ["odd", "nothing"])
def test_scores_of_odd_rows(spark, frame, request, monkeypatch):
    monkeypatch.setattr(kneser_ney, "RANGE_BYTES", 50_000)
    docs = request.getfixturevalue(frame).drop("learn").withColumn("learn", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)))
    rows = docs.select("text", "learn").collect()
    got = kneser_ney.score(docs, kneser_ney.train(docs)).collect()
    want = brute_scores([r.text for r in rows], [r.text for r in rows if r.learn])
    assert sorted((g.n_tokens, g.n_known, g.score) for g in got) == sorted((w[0], w[1], w[4].expected) for w in want) or [
        (g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score) for g in got
    ] == want


PAGES = {
    "": "",
    "<script>var a='<p>no</p>'": "",
    "just text": "just text",
    "<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Head &amp; tail</h1>"
    "<p>First   paragraph,\n with commas, and &eacute;.<br>still first<p>Second one is not closed<div class='share'>Share me</div></article>"
    "<footer>foot</footer>": "Head & tail\n\nFirst paragraph, with commas, and é. still first\n\nSecond one is not closed",
    "<div id=page><div class=side-bar><a href=a>menu one</a> <a href=b>menu two</a></div><div class=content><p>A long paragraph, that has commas, and goes on and on.</p>"
    "<p>Another long paragraph, also with commas, to be kept here.</p><ul><li>An item of a list</li></ul></div>"
    "<div class='comments'><p>I am a reader, and I comment at length, as readers do.</p></div></div>": "A long paragraph, that has commas, and goes on and on.\n\n"
    "Another long paragraph, also with commas, to be kept here.\n\nAn item of a list",
    "<main><section><p>One section of text, with a comma, long enough.</p></section><aside><p>Aside, with a comma, long enough to count too.</p></aside>"
    "<section><h2>Two</h2><p>Second section of text, with a comma, long enough.</p></section><form><p>Write to us, please, and tell us your name.</p></form></main>": "One section of text, "
    "with a comma, long enough.\n\nTwo\n\nSecond section of text, with a comma, long enough.",
    "<body><p>Short.</p><p>Also short.</p></body>": "Short.\n\nAlso short.",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_text.main_text(page) == PAGES[page]


PROSE = "A paragraph of the article, with commas, that goes on for quite a while."
OTHER = "A reader or an advert speaks here, at some length, about other things."
NAMED = {
    '<div class="content has-sidebar"><p>{0}</p><p>{0}</p></div><div class="sidebar"><p>{1}</p></div>': "{0}\n\n{0}",
    '<article class="post no-comments"><p>{0}</p><div class="comments-area"><p>{1}</p></div></article>': "{0}",
    '<article><h2 id="market-share">Market share</h2><p>{0}</p><section id="related-work"><h2>Related work</h2><p>{0}</p></section></article>': "Market share\n\n{0}\n\nRelated work\n\n{0}",
    '<article><p>{0}</p><section id="discussion"><h2>Discussion</h2><p>{0}</p></section><div class="related-posts"><a href=a>One of the other posts</a></div></article>': "{0}\n\nDiscussion\n\n{0}",
    '<article><p>{0}</p><ol><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ol></article>': "{0}\n\nFirst source\n\nSecond source",
    '<div><p>{0}</p><p>{0}</p><ol><li><a href=a>{1}</a></li></ol><ul><li><a href=b>Home</a></li></ul></div>': "{0}\n\n{0}\n\n{1}",
    '<div class="overlay"><div class="widget"><p>{0}</p></div></div><p>Foot</p>': "{0}\n\nFoot",
    '<div class="overlay"><article><p>{0}</p></article></div><div><p>{1}</p></div>': "{0}",
    '<div class="ad">{1}</div><article><h1>Head</h1><p>Short.</p></article>': "Head\n\nShort.",
    '<div class="ad">{1}</div><article><h1>Head</h1><div class="overlay"><p>{0}</p></div></article>': "Head\n\n{0}",
    '<article><p>{0} <span class="share-price">12</span></p><table><tr><td class="ad-spend">5</td></tr></table><p class="ad">{1}</p></article>': "{0} 12\n\n5",
    '<article><p>{0}</p><div id="comments"><article class="comment-body"><p>{1}</p></article></div></article>': "{0}",
}


@pytest.mark.parametrize("page", NAMED)
def test_names_cut_only_what_is_no_article(page):
    assert html_text.main_text(page.format(PROSE, OTHER)) == NAMED[page].format(PROSE, OTHER)


def test_pages_of_given_table(spark):
    pages = table(spark, SMALL, "pages")
    got = html_text.extract(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        assert r.n_chars == len(r.text) and "<p>" not in r.text and "©" not in r.text and "track(" not in r.text


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, 5), (None, "u", "", 6), (1, "u", "<p>" * 5000 + "deep", 7), (1, "u", "<b>" + "x " * 300_000, 8)], "page_id long, url string, html string, text int")
    got = {(r.page_id, r.url, r.n_chars) for r in html_text.extract(pages).collect()}
    assert got == {(1, None, 0), (None, "u", 0), (1, "u", 4), (1, "u", 599_999)}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pfair_slots(spark, make):
    """Over several plans: slots are a permutation, within release and deadline, and shares are off by less than a block."""
    sizes = {"a": 97, "b": 31, "c": 8, "d": 1}
    texts = [s for s, n in sizes.items() for _ in range(n)]
    docs = make(texts, source=[None if s == "d" else s for s in texts])
    weights = {"a": 5, "b": 3, "c": 2}
    got = mixing.mix(docs, weights, block=2).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    blocks = {(r.source, r.block): r for r in got}
    assert sorted(b.slot for b in blocks.values()) == list(range(len(blocks)))
    assert all(b.release <= b.slot < b.deadline for b in blocks.values())
    order = [b.source for b in sorted(blocks.values(), key=lambda b: b.slot)]
    share = {"a": 5 / 11, "b": 3 / 11, "c": 2 / 11}
    for t in range(1, 22):  # two whole cycles of all sources hold the given weights
        for s, w in share.items():
            assert abs(order[:t].count(s) - t * w) < (1 if t <= 11 else 2)
    assert mixing.mix(docs.limit(0), weights).count() == 0


def test_mix_of_odd_rows(spark, odd):
    got = mixing.mix(odd, carry=("text",)).collect()
    assert len(got) == odd.count() and sum(r.text is None for r in got) == 1


def test_pipeline_stages_by_brute_force(spark):
    """Every stage on the output of the one before, against its own definition."""
    from test_pairs import brute_classes

    steps = [table(spark, SMALL, "documents").select(*corpus_pipeline.COLUMNS)]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], SMALL)
        steps.append(spark.createDataFrame(out.collect(), out.schema))
    start, known, lined, single, clean, mixed = [{r.doc_id: r for r in s.collect()} for s in steps]
    assert all(s.columns == corpus_pipeline.COLUMNS for s in steps[:-1])
    assert len(known) >= 0.98 * len(start) and all(known[i].text == start[i].text for i in known)
    assert set(lined) == set(known) and all(r.n_chars == len(r.text) for r in lined.values())
    assert any(lined[i].text != known[i].text for i in lined)
    classes, _ = brute_classes({i: r.text for i, r in lined.items()}, 5, (4, 5))
    assert set(single) == set(classes.values())
    low = lambda t: f" {' '.join(x.decode() for x in t.encode().translate(LOW).split())} "
    items = [low(r.text) for r in table(spark, SMALL, "benchmark").collect()]
    leaked = {i for i, r in single.items() if any(x in low(r.text) for x in items)}
    assert leaked and set(clean) == set(single) - leaked
    assert set(mixed) == set(clean) and len({(r.slot, r.place) for r in mixed.values()}) == len(mixed)


def test_pipeline_of_odd_rows(spark, odd, nothing):
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            docs = spark.createDataFrame(out.collect(), out.schema)
