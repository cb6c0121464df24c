"""Ranks in long windows by brute force, the complete report, test spans, bootstrap weights."""

import math
import random
import time
from datetime import datetime, timedelta

import pytest

from candlespark.operators import features as X
from candlespark.operators import metrics as M
from candlespark.operators import splits as V

START = datetime(2024, 1, 1)


def bars(spark, series):
    rows = [(s, START + timedelta(minutes=i), v, i) for s, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, close double, i int")


def by_hand(values, k):
    out = []
    for i in range(len(values)):
        window = values[max(0, i - k + 1) : i + 1]
        whole = len(window) == k and all(v is not None and v == v for v in window)
        out.append(sum(v <= values[i] for v in window) / k if whole else None)
    return out


def test_trailing_rank_over_blocks(spark):
    draw = random.Random(8)
    long = [draw.choice([draw.gauss(0, 1), 0.0, 1.0]) for _ in range(9_500)]
    for i, v in ((300, None), (4_096, float("nan")), (4_200, None), (7_000, float("inf"))):
        long[i] = v
    series = {"long": long, "short": [1.0, 2.0], "flat": [3.0] * 80, "null": [None] * 60}
    got = {}
    for r in X.trailing_rank(bars(spark, series), 50).collect():
        got.setdefault(r.symbol, {})[r.i] = r.pct_rank
    for symbol, values in series.items():
        assert [got[symbol][i] for i in range(len(values))] == pytest.approx(by_hand(values, 50), nan_ok=False)


def test_trailing_rank_equals_the_window_form(spark):
    df = bars(spark, {"a": [float(i * 37 % 101) for i in range(500)]})
    one = X.rolling(df, 23, lambda d, w: X.percentile_rank(d, w, 24))
    assert sorted(r.asDict().items() for r in one.collect()) == sorted(r.asDict().items() for r in X.trailing_rank(df, 24).select(*one.columns).collect())


def test_window_of_ten_thousand(spark):
    df = spark.range(40_000).selectExpr("'a' AS symbol", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS open_time", "(id * 7919 % 10007) * 1D AS close")
    start = time.time()
    out = X.trailing_rank(df, 10_000).agg({"pct_rank": "count"}).first()[0]
    assert out == 30_001 and time.time() - start < 60


def test_empty_bars(spark):
    assert X.trailing_rank(bars(spark, {}), 5).count() == 0


def test_complete_report_with_and_without_keys(spark):
    draw = random.Random(9)
    rows = [("a", START + timedelta(hours=i), draw.gauss(0, 1), draw.gauss(0, 1)) for i in range(200)]
    pairs = spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, y_true double, y_pred double")
    keyed, whole = M.evaluate_complete(pairs, ["symbol"]).first().asDict(), M.evaluate_complete(pairs).first().asDict()
    assert keyed.pop("symbol") == "a" and keyed == pytest.approx(whole)
    assert {"spearman_r", "spearman_pvalue", "zptae_improvement", "grade"} <= set(whole)
    assert whole["spearman_r"] == pytest.approx(M.spearman(pairs, ["symbol"]).first().spearman_r)


def test_coverage_plan(spark):
    got = {(r.symbol, r.test_size): (r.n_test_rows, r.n_folds, r.n_covered) for r in V.coverage_plan(bars(spark, {"a": [1.0] * 100, "b": [1.0] * 3}), 0.4, [10, 15, 60]).collect()}
    assert got == {("a", 10): (40, 4, 40), ("a", 15): (40, 2, 30), ("a", 60): (40, 1, 60), ("b", 10): (1, 1, 3), ("b", 15): (1, 1, 3), ("b", 60): (1, 1, 3)}


def test_bootstrap_weights_reach_the_tail():
    assert M.POISSON_1 == sorted(M.POISSON_1) and len(M.POISSON_1) > 10
    mean = sum(1 - f for f in M.POISSON_1)
    assert mean == pytest.approx(1, abs=1e-8) and M.POISSON_1[0] == math.exp(-1) and M.POISSON_1[-1] <= 1 - 2.0**-32
