"""Spans that reach into another role, against all pairs of a small table."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from candlespark.operators import splits as V

START = datetime(2024, 1, 1)


def table(spark, rows):
    times = [(s, f, r, None if m is None else START + timedelta(minutes=m)) for s, f, r, m in rows]
    return spark.createDataFrame(times, "symbol string, fold int, role string, open_time timestamp_ntz")


def by_pairs(rows, h, w):
    out = Counter()
    rows = [x for x in rows if None not in x]
    for s, f, r, t in rows:
        for s2, f2, r2, u in rows:
            if (s, f) == (s2, f2) and r != r2:
                if abs(t - u) < h:
                    out[s, f, r, r2, "label", t] += 1
                if t - w - h <= u < t:
                    out[s, f, r, r2, "feature", t] += 1
    # A row given twice is one row of the result, which counts the others once.
    copies = Counter(rows)
    return {k: n // copies[k[0], k[1], k[2], k[5]] for k, n in out.items()}


@pytest.mark.parametrize("h,w,seed", [(1, 0, 1), (5, 0, 2), (7, 30, 3), (60, 500, 4), (0, 9, 5)])
def test_overlaps_by_all_pairs(spark, h, w, seed):
    draw = random.Random(seed)
    rows = [(draw.choice("ab"), draw.randrange(2), draw.choice(["train", "validation", "test"]), draw.randrange(-200, 2_000)) for _ in range(300)]
    rows += rows[:20] + [("a", 0, "train", None), (None, 0, "train", 5), ("a", 0, None, 5), ("a", None, "test", 5)]
    got = V.overlaps(table(spark, rows), h * 60, w * 60, cell_s=3_600).collect()
    found = {(r.symbol, r.fold, r.role, r.other_role, r.kind, int((r.open_time - START).total_seconds() // 60)): r.n_other for r in got}
    assert found == by_pairs(rows, h, w) and len(got) == len(found)


def test_planted_overlap_of_stages(spark):
    rows = [("a", 0, "inner", m) for m in range(100)] + [("a", 0, "evaluation", m) for m in range(110, 150)] + [("b", 0, "deployment", 105)]
    split = table(spark, rows).withColumnRenamed("role", "stage")
    assert V.overlaps(split, 11 * 60, 0, role="stage").where("kind = 'label'").count() == 0
    found = V.overlaps(split, 12 * 60, 0, role="stage").where("kind = 'label'").collect()
    assert {(r.stage, r.open_time.minute + 60 * r.open_time.hour, r.n_other) for r in found} == {("inner", 99, 1), ("evaluation", 110, 1)}
    report = V.overlap_report(V.overlaps(split, 12 * 60, 0, role="stage"), role="stage").where("kind = 'label'").collect()
    assert {(r.stage, r.other_stage, r.n_rows, r.most_others) for r in report} == {("inner", "evaluation", 1, 1), ("evaluation", "inner", 1, 1)}


def test_empty_split(spark):
    assert V.overlaps(table(spark, []), 60, 60).count() == 0
