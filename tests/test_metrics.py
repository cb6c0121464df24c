"""Metric rules on small arrays, and tail probabilities against known values."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlespark.functions import losses as L
from candlespark.functions.tails import betainc
from candlespark.operators import metrics as M


def evaluate(spark, y, p, **kw):
    t0 = dt.datetime(2024, 1, 1)
    pdf = pd.DataFrame({"open_time": [t0 + dt.timedelta(hours=i) for i in range(len(y))], "y_true": np.asarray(y, float), "y_pred": np.asarray(p, float)})
    df = spark.createDataFrame(pdf).withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))
    return M.evaluate(df, [], **kw).first().asDict()


SIGNS = np.array([0.01, -0.02, 0.03, -0.01, 0.02] * 20)


def test_perfect_direction(spark):
    r = evaluate(spark, SIGNS, SIGNS)
    assert r["directional_accuracy"] == 1 and r["da_pvalue"] < 0.05
    assert r["czar_improvement"] == pytest.approx(1) and r["wrmse_improvement"] == pytest.approx(1)
    assert r["num_passed"] == 7 and r["grade"] == "A+" and r["score"] == pytest.approx(1)


def test_opposite_direction(spark):
    r = evaluate(spark, SIGNS, -SIGNS)
    assert r["directional_accuracy"] == 0 and r["czar_improvement"] == pytest.approx(-1)


def test_random_predictions(spark):
    rng = np.random.default_rng(42)
    r = evaluate(spark, rng.normal(size=1000) * 0.01, rng.normal(size=1000) * 0.01)
    assert 0.4 < r["directional_accuracy"] < 0.6 and r["num_passed"] <= 3
    assert r["da_ci_lower"] < r["directional_accuracy"] < r["da_ci_upper"]


def test_zero_prediction_has_no_gain(spark):
    r = evaluate(spark, SIGNS, np.zeros(100))
    assert r["wrmse_improvement"] == pytest.approx(0) and r["directional_accuracy"] == 0
    assert r["pearson_r"] == 0 and r["pearson_pvalue"] == 1 and r["log_aspect_ratio"] == 0


def test_autocorrelation_thins_the_sample(spark):
    rng = np.random.default_rng(1)
    y = np.zeros(500)
    for i in range(1, 500):
        y[i] = 0.9 * y[i - 1] + rng.normal() * 0.01
    p = np.full(500, 0.001)
    r = evaluate(spark, y, p)
    c = (np.sign(y[y != 0]) == np.sign(p[y != 0])).astype(float)
    rho = max(np.corrcoef(c[:-1], c[1:])[0, 1], 0)
    n = len(c)
    assert r["da_autocorrelation"] == pytest.approx(rho, abs=1e-9)
    assert r["da_n_effective"] == pytest.approx(max(n * (1 - rho) / (1 + rho), 2)) and r["da_n_effective"] < n


def test_cell_width_does_not_matter(spark):
    rng = np.random.default_rng(5)
    y, p = rng.normal(size=300), rng.normal(size=300)
    y[::7] = 0
    a, b = (evaluate(spark, y, p, cell_s=c) for c in (3600, 10**7))
    for k, v in a.items():
        assert v == pytest.approx(b[k]) if isinstance(v, float) else v == b[k], k


def test_all_outcomes_zero(spark):
    r = evaluate(spark, np.zeros(10), np.ones(10))
    assert (r["directional_accuracy"], r["da_ci_lower"], r["da_ci_upper"], r["da_pvalue"]) == (0.5, 0, 1, 1)
    assert r["czar_improvement"] == 0 and r["wrmse_improvement"] == 0 and math.isinf(r["mape"])


def test_coverage(spark):
    assert evaluate(spark, SIGNS, SIGNS, n_expected=150)["temporal_coverage_pass"]
    assert not evaluate(spark, SIGNS, SIGNS, n_expected=300)["temporal_coverage_pass"]
    assert not evaluate(spark, SIGNS, SIGNS, n_expected=0)["temporal_coverage_pass"]


def test_against_numpy(spark):
    rng = np.random.default_rng(7)
    y = rng.normal(size=200)
    p = 0.3 * y + 0.7 * rng.normal(size=200)
    r = evaluate(spark, y, p)
    w = np.abs(y)
    assert r["pearson_r"] == pytest.approx(np.corrcoef(y, p)[0, 1])
    assert r["wrmse_model"] == pytest.approx(np.sqrt((w * (y - p) ** 2).sum() / w.sum()))
    assert r["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert r["std_pred"] == pytest.approx(p.std()) and r["mape"] == pytest.approx(np.mean(np.abs((y - p) / y)) * 100)


@pytest.mark.parametrize("a,b,x,want", [(1, 1, 0.3, 0.3), (2, 3, 0.5, 0.6875), (0.5, 0.5, 0.5, 0.5), (5, 1, 0.9, 0.59049), (1, 4, 0.2, 1 - 0.8**4)])
def test_betainc(a, b, x, want):
    assert betainc([a], [b], [x])[0] == pytest.approx(want, abs=1e-12)


def test_t_and_binomial_tails():
    # Two-sided 5 % point of Student's t with 10 degrees of freedom.
    t = 2.2281388519649385
    assert betainc([5.0], [0.5], [10 / (10 + t * t)])[0] == pytest.approx(0.05, abs=1e-10)
    exact = sum(math.comb(20, k) for k in range(15, 21)) / 2**20
    assert betainc([15.0], [6.0], [0.5])[0] == pytest.approx(exact, abs=1e-12)


def test_spearman_with_ties(spark):
    y, p = [1, 2, 2, 3, 5, 5, 5], [2, 1, 4, 4, 6, 5, 7]
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "y_true": np.array(y, float), "y_pred": np.array(p, float)}))
    want = np.corrcoef(pd.Series(y).rank(), pd.Series(p).rank())[0, 1]
    assert M.spearman(df, ["g"]).first().spearman_r == pytest.approx(want)


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "v string, p double")
    got = {r.v: (r.bonferroni, r.holm) for r in M.adjust_pvalues(df, "p", ["v"]).collect()}
    assert got["a"] == pytest.approx((0.03, 0.03)) and got["c"] == pytest.approx((0.09, 0.06)) and got["b"] == pytest.approx((0.12, 0.06))


def test_loss_shape(spark):
    df = spark.createDataFrame([(y / 4, p / 4) for y in range(-8, 9) for p in range(-8, 9)], "y double, p double")
    bare = L.czar_loss("y", "p", 1.0, epsilon=0)
    got = df.select("y", "p", bare.alias("l"), L.czar_hessian("y", "p", 1.0).alias("h")).toPandas()
    assert (got.l >= -1e-12).all() and (got.h > 0).all()
    assert got[got.y == got.p].l.abs().max() < 1e-12
    wrong, right = got[(got.y == 1) & (got.p == -1)].l.iloc[0], got[(got.y == 1) & (got.p == 0.5)].l.iloc[0]
    assert wrong > right
    with pytest.raises(ValueError):
        L.czar_loss("y", "p", 1.0, alpha=2)


def test_loss_gradient_between_zero_and_outcome(spark):
    """On the middle part the gradient is the exact derivative."""
    h = 1e-5
    df = spark.createDataFrame([(1.5, 0.4), (-1.5, -0.7), (2.0, 1.1)], "y double, p double")
    up, down = (L.czar_loss("y", F.col("p") + s * h, 1.0, epsilon=0) for s in (1, -1))
    for r in df.select(((up - down) / (2 * h)).alias("n"), L.czar_gradient("y", "p", 1.0).alias("g")).collect():
        assert r.n == pytest.approx(r.g, rel=1e-6)


def test_tails_can_be_sent_after_use():
    """The helpers are pickled by value with the query, also once the driver has called them."""
    from pyspark import cloudpickle

    from candlespark.functions import tails

    assert tails.betainc([2.0], [3.0], [0.5])[0] == pytest.approx(0.6875)
    cloudpickle.dumps(tails.binomial_tail.func)


def test_return_loss_is_an_area(spark):
    """Zero at the outcome, continuous at both joints, slope 1 through zero, and a softening that starts at the area up to epsilon."""
    from candlespark.functions import losses as L

    rows = [(1.3, 1.3), (1.3, 1e-9), (1.3, -1e-9), (1.3, 1.3 + 1e-9), (-0.4, -0.4), (0.0, 0.0)]
    got = [r.x for r in spark.createDataFrame(rows, "y double, p double").select(L.czar_loss("y", "p", F.lit(1.0), epsilon=0).alias("x")).collect()]
    assert got[0] == pytest.approx(0, abs=1e-12) and got[3] == pytest.approx(0, abs=1e-8) and got[4] == pytest.approx(0, abs=1e-12) and got[5] == 0
    assert got[1] == pytest.approx(got[2], abs=1e-8) and (got[2] - got[1]) / 2e-9 == pytest.approx(1, rel=1e-4)
    soft = spark.range(1).select(L.softening(F.lit(0.0), 1.0, 1.0, 0.05).alias("x"), L.softening(F.lit(1.0), 1.0, 1.0, 0.0).alias("z")).first()
    assert soft.x == pytest.approx(L.Weight(1.0).area_to(1.0)) and soft.z == pytest.approx(0, abs=1e-12)
