"""How the n-gram model reads and searches: few visits to its ranges, learned texts alone, the same scores for any gathering."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candlespark.llm import kneser_ney
from candlespark.llm.common import table
from test_scores import SMALL, brute_scores, tokens


@pytest.fixture
def docs(spark):
    learn = F.when(F.col("doc_id") % 4 != 1, F.lit(True))  # null for the others
    return table(spark, SMALL, "documents").select("doc_id", "text", "lang", learn.alias("learn")).orderBy("doc_id").limit(60)


class Here:
    """Stands for a DataFrame whose Python function runs in this process, on given batches."""

    def __init__(self, batches):
        self.batches = batches

    def select(self, *columns):
        return self

    def mapInArrow(self, fn, schema):
        return [r for b in fn(iter(self.batches)) for r in b.to_pylist()]


def test_small_batches_visit_each_range_once(docs, monkeypatch):
    monkeypatch.setattr(kneser_ney, "RANGE_BYTES", 20_000)
    rows = docs.collect()
    model = kneser_ney.train(docs)
    visits = []
    find = kneser_ney.Rows.find
    monkeypatch.setattr(kneser_ney.Rows, "find", lambda part, *a: (visits.append(id(part)), find(part, *a)))
    batches = [pa.record_batch({"doc_id": [r.doc_id], "text": [r.text], "learn": [bool(r.learn)]}) for r in rows]
    got = kneser_ney.score(Here(batches), model)
    assert model.ranges > 5 and len(visits) == len(set(visits)) <= 3 * model.ranges
    want = brute_scores([r.text for r in rows], [r.text for r in rows if r.learn])
    assert [(g["n_tokens"], g["n_known"], g["train_tokens"], g["base_score"], g["score"]) for g in got] == want
    assert [(g["doc_id"], g["learn"]) for g in got] == [(r.doc_id, bool(r.learn)) for r in rows]


@pytest.mark.parametrize("gather, pack", [(1, 1), (300, 1_000)])
def test_scores_for_any_gathering(docs, monkeypatch, gather, pack):
    monkeypatch.setattr(kneser_ney, "GATHER", gather)
    monkeypatch.setattr(kneser_ney, "PACK", pack)
    rows = docs.collect()
    want = brute_scores([r.text for r in rows], [r.text for r in rows if r.learn])
    got = kneser_ney.score(docs, kneser_ney.train(docs)).orderBy("doc_id").collect()
    assert [(g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score) for g in got] == want


def test_numbers_of_grams_and_contexts():
    texts = ["a b a b", None, "", "b a"]
    batches = [pa.record_batch({"doc_id": [k], "text": pa.array([t], pa.string())}) for k, t in enumerate(texts)]
    ((rows, g),) = kneser_ney._gathered(iter(batches), 3, 100)
    assert rows.column_names == ["doc_id"] and rows["doc_id"].to_pylist() == [0, 1, 2, 3]
    for level in (1, 2):
        keys, at, before = g.numbered(level)
        assert (np.diff(keys.astype(float)) > 0).all() and (keys[at] == g.ending[level]).all()
        grams = [(tuple((["begin"] * level + tokens(t))[i + 1 : i + 1 + level]), tuple((["begin"] * level + tokens(t))[i : i + level])) for t in texts for i in range(len(tokens(t)))]
        numbers = {x: k for x, k in zip([x for x, _ in grams], at, strict=True)} | {("begin",) * level: before[0]}
        assert len(numbers) == len(set(numbers.values())) == len(keys)
        assert [numbers[x] for x, _ in grams] == at.tolist() and [numbers[y] for _, y in grams] == before.tolist()


def test_training_sends_learned_texts_alone(docs, monkeypatch):
    sent = []
    kind = type(docs)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, *a, **k: (sent.append(df), real(df, *a, **k))[1])
    kneser_ney.train(docs)
    sweeps = [df for df in sent if "text" in df.columns]
    assert [df.columns for df in sweeps] == [["text"]] * 3
    want = sorted(r.text for r in docs.collect() if r.learn)
    assert all(sorted(r.text for r in df.collect()) == want for df in sweeps)
