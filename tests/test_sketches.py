"""Stored quantile sketches: accuracy, merging, drift by hand, what a report reads."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlespark.operators import sketches as K
from candlespark.session import shared_dir

ODD = [None, float("nan"), 0.0, -0.0, float("inf"), -float("inf"), 5e-324, -1.7e308, 1.0, -1.0]


def frame(spark, values, symbol="a"):
    return spark.createDataFrame([(symbol, None if v is None else float(v)) for v in values], "symbol string, x double")


def cells(made):
    return {(r.symbol, r.feature, r.cell): r.n for r in made.collect()}


def test_cells_keep_the_order_and_the_accuracy(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=500), rng.lognormal(0, 30, 300), -rng.lognormal(0, 30, 300), [0, 5e-324, 1.7e308, -1.7e308]])
    for accuracy in (0.01, 0.2):
        rows = frame(spark, values).withColumn("c", K.cell_of("x", accuracy)).withColumn("m", K.cell_middle("c", accuracy)).orderBy("x").collect()
        assert [r.c for r in rows] == sorted(r.c for r in rows)
        assert all(abs(r.m - r.x) <= accuracy * 1.001 * abs(r.x) for r in rows if abs(r.x) > 1e-300)


def test_odd_values(spark):
    made = cells(K.sketch(frame(spark, ODD), ["symbol"], ["x"]))
    assert sum(made.values()) == len(ODD) and made["a", "x", None] == 2 and made["a", "x", 0] == 2
    top = max(c for _, _, c in made if c is not None)
    assert made["a", "x", top] == 1 and made["a", "x", -top] == 1


def test_merging_parts_equals_the_whole(spark):
    values = np.random.default_rng(4).normal(size=1_000)
    parts = [K.sketch(frame(spark, values[i::3]), ["symbol"], ["x"]) for i in range(3)]
    assert cells(K.merged(*parts)) == cells(K.sketch(frame(spark, values), ["symbol"], ["x"]))


def test_quantiles_within_the_accuracy(spark):
    values = np.sort(np.random.default_rng(5).lognormal(size=777))
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.share: r.value for r in K.quantiles(K.sketch(frame(spark, [*values, None]), ["symbol"], ["x"]), ["symbol"], shares).collect()}
    for s in shares:
        assert got[s] == pytest.approx(values[max(math.ceil(s * 777), 1) - 1], rel=0.0101)


def test_drift_by_hand(spark):
    train, live = [float(i) for i in range(1, 41)], [float(i) for i in range(21, 61)] + [None] * 10
    d = K.drift(K.sketch(frame(spark, train), ["symbol"], ["x"]), K.sketch(frame(spark, live), ["symbol"], ["x"]), ["symbol"], bins=4).collect()
    # Bins of ten training rows; live rows beyond the last fall into it.
    o, n = np.array([10, 10, 10, 10]) + 0.5, np.array([0, 0, 10, 30]) + 0.5
    so, sn = o / 42, n / 42
    assert len(d) == 1 and (d[0].n_train, d[0].n_live) == (40, 50)
    assert d[0].psi == pytest.approx(((sn - so) * np.log(sn / so)).sum())
    assert d[0].ks == pytest.approx(0.5) and d[0].missing_shift == pytest.approx(0.2)


def test_drift_of_equal_missing_and_unknown_groups(spark):
    train = K.merged(K.sketch(frame(spark, [1, 2, 3, None]), ["symbol"], ["x"]), K.sketch(frame(spark, [None, None], "m"), ["symbol"], ["x"]))
    live = K.merged(*[K.sketch(frame(spark, v, s), ["symbol"], ["x"]) for v, s in (([1, 2, 3, None], "a"), ([1.0], "m"), ([1.0], "new"))])
    d = {r.symbol: r for r in K.drift(train, live, ["symbol"]).collect()}
    assert set(d) == {"a", "m"}
    assert d["a"].psi == pytest.approx(0) and d["a"].ks == 0 and d["a"].missing_shift == 0
    assert d["m"].psi is None and d["m"].ks is None and d["m"].missing_shift == -1


def test_a_model_keeps_its_own_sketch(spark):
    path = shared_dir(spark, "sketches")
    first, second = (K.sketch(frame(spark, v), ["symbol"], ["x"]) for v in ([1, 2], [3]))
    K.store(first, path, "m1")
    K.store(second, path, "m2")
    K.store(second, path, "m1")
    assert cells(K.stored(spark, path, "m1")) == cells(K.stored(spark, path, "m2")) == cells(second)
    with pytest.raises(Exception, match="another accuracy"):
        K.stored(spark, path, "m1", 0.05).collect()


def test_a_report_reads_the_sketch_only(spark):
    path, data = shared_dir(spark, "sketches"), shared_dir(spark, "training")
    frame(spark, range(100)).write.parquet(data)
    K.store(K.sketch(spark.read.parquet(data), ["symbol"], ["x"]), path, "m1")
    live = K.sketch(frame(spark, range(50)), ["symbol"], ["x"])
    text = K.drift(K.stored(spark, path, "m1"), live, ["symbol"])._jdf.queryExecution().executedPlan().toString()
    assert data not in text and len(re.findall("FileScan", text)) == 1
    assert re.search(r"PartitionFilters: \[[^\]]*model", text)


def test_empty_tables(spark):
    none, some = (K.sketch(frame(spark, v), ["symbol"], ["x"]) for v in ([], [1.0]))
    assert none.count() == K.drift(none, some, ["symbol"]).count() == K.drift(some, none, ["symbol"]).count() == 0
    assert K.quantiles(none, ["symbol"], [0.5]).where(F.lit(True)).count() == 0
