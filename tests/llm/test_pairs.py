"""Near-duplicates, benchmark leaks, licenses: against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from candlespark.llm import decontaminate, graph, licenses, minhash, queries
from candlespark.llm.common import table
from candlespark.llm.license_texts import TEMPLATES

SMALL = "/root/testdata/sf0.001"
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    w = (text or "").encode().translate(LOW).split()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_classes(texts, size, share):
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    holders = defaultdict(list)
    for i in ids:
        near = {j for x in sets[i] for j in holders[x]}
        for j in near:
            both = len(sets[i] & sets[j])
            if share[1] * both >= share[0] * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in sets[i]:
            holders[x].append(i)
    return {i: find(i) for i in ids}, {i: len(sets[i]) for i in ids}


def words(rng, n):
    return [rng.choice("abcdefgh") + str(rng.randrange(4000)) for _ in range(n)]


def edited(rng, own, rate):
    return [w if rng.random() > rate else f"e{rng.randrange(10**6)}" for w in own]


def test_near_duplicates_of_given_table(spark):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    want, sizes = brute_classes(texts, 3, (85, 100))
    for r in queries.QUERIES["op5_near_dedup"](spark, SMALL).collect():
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_copies_around_the_threshold(spark, make, monkeypatch):
    """One base with many copies at different distances, chains, tiny sets; small blocks, so that groups are cut."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "TEXT_BLOCK", 8)
    rng = random.Random(5)
    base = words(rng, 120)
    texts = [" ".join(edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.05, 0.08]))) for _ in range(60)]
    chain = words(rng, 60)
    for k in range(12):
        texts.append(" ".join(chain))
        chain = [*chain[3:], *words(rng, 3)]
    texts += ["one two", "One  TWO", "one", "", None, " \n", *[" ".join(words(rng, 40)) for _ in range(20)]]
    rng.shuffle(texts)
    want, sizes = brute_classes(dict(enumerate(texts)), 3, (85, 100))
    got = {r.doc_id: r for r in minhash.classes(make(texts), 3, (85, 100)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want and {i: r.n_shingles for i, r in got.items()} == sizes
    kept = minhash.keep_one(make(texts), 3, (85, 100)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    edges, _ = minhash._lookups()
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(30):
            pool = rng.integers(0, 1 << 63, 2000, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            n = int(1000 * share)
            rows = [np.unique(x) for x in (pool[:1000], np.concatenate([pool[:n], pool[1000 : 2000 - n]]))]
            least = np.array([x[np.minimum(np.searchsorted(x, edges), len(x) - 1)] for x in rows])
            full = least >> np.uint64(57) == np.arange(128, dtype=np.uint64)
            regs = minhash.registers(least, full)
            same = np.array([(regs[0] == regs[1]).sum()])
            errors.append(minhash.estimate(same, np.array([1000.0]), np.array([1000.0]))[0] - n / (2000 - n))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 200)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {0, 100} and got[200] == 0 and len(got) == 41 + 30 + 1
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leaks_by_brute_force():
    """Items with a few words changed, in random surroundings: what shares 0.8 of the weight is found."""
    rng = random.Random(11)
    items = [" ".join(words(rng, rng.choice([12, 20, 33, 50]))) for _ in range(30)] + ["one two", "", None]
    texts = []
    for k in range(300):
        own = (items[k % 30] or "").split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join([*words(rng, rng.randrange(40)), *own, *words(rng, rng.randrange(40))]))
    texts += ["One, two.", "one two three", "", None]
    ix = decontaminate.index(list(range(len(items))), items, (4, 5))
    got = {(m[0], ix.ids[m[1]]): m[2] / m[3] for m in decontaminate.matches_of(list(decontaminate._suspects(pa.array(texts), ix)), ix, (4, 5))}
    rarity = dict(zip(ix.known.tolist(), ix.weight.tolist(), strict=True))
    sized = {k: length for length, one in ix.lengths.items() for k in one.items.tolist()}
    want = {}
    for i, _, hashes in decontaminate._of(pa.array(texts)):
        hashes = hashes.tolist()
        for k, own in enumerate(ix.sets):
            m, best = min(ix.lengths[sized[k]].shingles, len(hashes)), 0
            for p in range(len(hashes) - m + 1):
                bag = Counter()
                for x in hashes[p : p + m]:
                    bag[x] += rarity.get(x, ix.rare)
                both = sum(min(w, own[x]) for x, w in bag.items() if x in own)
                best = max(best, both / (sum(bag.values()) + sum(own.values()) - both)) if both else best
            if best >= 0.8:
                want[i, ix.ids[k]] = best
    assert len(want) > 100 and got == pytest.approx(want)


def test_parts_of_the_benchmark_match_as_one(spark, make, monkeypatch):
    """Items that share passages fall into different parts; similarities stay those of one index."""
    rng = random.Random(3)
    shared = [" ".join(words(rng, 12)) for _ in range(4)]
    items = [" ".join([rng.choice(shared), *words(rng, 20), rng.choice(shared)]) for _ in range(40)]
    texts = []
    for k in range(240):
        own = items[k % 40].split()
        for _ in range(k % 4):
            own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join([rng.choice(shared), *own, rng.choice(shared)]))
    docs, benchmark = make(texts), make([*items, None, " "]).selectExpr("doc_id AS item_id", "text")
    want = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, benchmark).collect()}
    kept = {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "PART_BYTES", sum(map(len, items)) // 5)
    assert len(want) > 50 and {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, benchmark).collect()} == want
    assert {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()} == kept


def test_block_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 256, (50, 16), np.uint8)
    one = decontaminate.Length(1, 0.0, np.arange(50), prints)
    near = np.concatenate([[0], 1 << np.arange(8)]).astype(np.uint8)
    for part in range(16):
        values = (prints[:, part, None] ^ near).astype(np.int64)
        order = np.argsort(values.ravel(), kind="stable")
        one.first.append(np.searchsorted(values.ravel()[order], np.arange(257)))
        one.found.append(np.repeat(np.arange(50), len(near))[order])
    asked = np.repeat(prints, 8, axis=0)
    for row in asked:
        for bit in rng.choice(128, rng.integers(0, 45), replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    row, item, far = decontaminate.within(one, asked)
    distance = np.bitwise_count(asked[:, None] ^ prints[None]).sum(axis=2)
    assert set(zip(row.tolist(), item.tolist(), strict=True)) == set(zip(*[x.tolist() for x in np.nonzero(distance <= decontaminate.RADIUS)], strict=True))


def test_license_spans(spark, make):
    mit = TEMPLATES["MIT"]
    cut = mit.replace("including without limitation", "including").replace("free of charge", "free of any charge")
    texts = [f"é {TEMPLATES['MIT line']}\nmore", f"before, {mit} after", f"x {cut} y", "nothing here", None, "", " ".join([TEMPLATES["Apache-2.0 line"]] * 5)]
    got = defaultdict(list)
    for r in licenses.scan(make(texts)).orderBy("doc_id", "first_char").collect():
        got[r.doc_id].append(r)
    assert [r.license for r in got[0]] == ["MIT line"] and texts[0][got[0][0].first_char : got[0][0].last_char] == "Released under the MIT License"
    (whole,) = got[1]
    assert whole.license == "MIT" and whole.coverage == 1 and texts[1][whole.first_char : whole.last_char] + "." == mit
    assert [r.license for r in got[2]] == ["MIT"] and 0.9 < got[2][0].coverage < 1
    assert not got[3] and not got[4] and not got[5] and [r.coverage for r in got[6]] == [1.0] * 5


def test_license_lines_of_given_table(spark):
    texts = [r.text for r in table(spark, SMALL, "documents").collect()]
    want = sum(t.count(TEMPLATES[n]) for t in texts for n in TEMPLATES if n.endswith("line"))
    assert queries.QUERIES["op6_license_spans"](spark, SMALL).where("coverage = 1").count() == want


def test_every_license_line_of_the_data_is_found(spark):
    """The lines are taken from the documents: prose there is invented, so a line that speaks of rights is a planted notice."""
    want = Counter()
    for r in table(spark, "/root/testdata/sf0.01", "documents").collect():
        for line in (r.text or "").splitlines():
            if re.search(r"licens|rights reserved|copyright", line, re.I):
                want[r.doc_id, line.strip(" .")] += 1
    docs = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = queries.QUERIES["op6_license_spans"](spark, "/root/testdata/sf0.01").where("coverage = 1").collect()
    assert len({line for _, line in want}) == 5 and Counter((r.doc_id, docs[r.doc_id][r.first_char : r.last_char]) for r in rows) == want


def test_short_and_whole_notices(spark, make):
    """Three words are found in whatever surroundings; a notice counts as whole only with all of its sentences."""
    rng = random.Random(5)
    texts = [" ".join([*words(rng, rng.randrange(30)), "All rights reserved.", *words(rng, rng.randrange(30))]) for _ in range(200)]
    assert licenses.scan(make(texts)).where("license = 'All rights reserved line' AND coverage = 1").count() == 200
    names = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "CC0-1.0 notice", "GPL-2.0 notice", "GPL-3.0 notice", "LGPL-2.1 notice", "LGPL-3.0 notice", "AGPL-3.0 notice"]
    got = defaultdict(dict)
    for r in licenses.scan(make([f"before {TEMPLATES[n]} after" for n in names])).collect():
        got[names[r.doc_id]][r.license] = r
    for n in names:
        assert got[n][n].coverage == 1 and max(got[n].values(), key=lambda r: r.n_matched).license == n
    assert "BSD-3-Clause" not in got["BSD-2-Clause"] and "BSD-3-Clause third clause" not in got["BSD-2-Clause"]
    for n, said in {"MIT": "LIABLE FOR ANY CLAIM", "BSD-3-Clause": "SUCH DAMAGE", "ISC": "DISCLAIMS ALL WARRANTIES", "Unlicense": "relinquishment"}.items():
        assert said in TEMPLATES[n]


@pytest.mark.parametrize("frame", ["odd", "nothing"])
def test_odd_rows(spark, frame, request):
    docs = request.getfixturevalue(frame)
    got = minhash.classes(docs).collect()
    assert len(got) == docs.count()
    if got:
        by_id = defaultdict(set)
        for r in got:
            by_id[r.doc_id].add((r.component_id, r.kept))
        assert by_id[7] == {(6, False)} and by_id[6] == {(6, True)} and by_id[1] == {(1, True)} and by_id[9] == {(8, False)}
    benchmark = request.getfixturevalue("odd").selectExpr("doc_id AS item_id", "text")
    leaks = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, benchmark).collect()}
    assert not got or {(6, 6), (7, 6), (6, 7), (8, 8), (9, 8)} <= leaks
    kept = {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()}
    assert kept == ({1, 2, 3, 4} if got else set())
    assert decontaminate.matches(docs, benchmark.limit(0)).count() == 0
    assert licenses.scan(docs).count() == 0
