"""Block helpers against plain windows, on skewed and gappy histories."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from candlespark.operators import blocks as B
from candlespark.operators.asof import asof_join, interval_join


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    t0 = dt.datetime(2024, 1, 1)
    for sym, n in (("hot", 700), ("a", 40), ("b", 1), ("c", 3)):
        minutes = np.cumsum(rng.choice([1, 1, 1, 2, 90, 4000], size=n))
        for i, m in enumerate(minutes):
            v = float(np.round(rng.normal(), 1))
            out.append((sym, t0 + dt.timedelta(minutes=int(m)), v, None if rng.random() < 0.4 else v))
    return spark.createDataFrame(pd.DataFrame(out, columns=["symbol", "open_time", "x", "y"]).astype({"y": float})).withColumn(
        "open_time", F.col("open_time").cast("timestamp_ntz")).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).cache()


def same(a, b, digits=9):
    cols = sorted(a.columns)
    pa, pb = (d.toPandas()[cols].sort_values(cols[:]).reset_index(drop=True) for d in (a, b))
    for p in (pa, pb):
        for c in p.select_dtypes("float"):
            p[c] = p[c].round(digits)
    pa, pb = (p.sort_values(["symbol", "open_time"]).reset_index(drop=True) for p in (pa, pb))
    pd.testing.assert_frame_equal(pa, pb, check_dtype=False)


W = lambda: Window.partitionBy("symbol").orderBy("open_time")


@pytest.mark.parametrize("cell_s", [60, 3600, 86_400, 40 * 86_400])
def test_row_index(rows, cell_s):
    got = B.row_index(rows, ["symbol"], "open_time", cell_s=cell_s, total="n")
    want = rows.withColumn("row_idx", F.row_number().over(W()) - 1).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    same(got, want)


@pytest.mark.parametrize("block_rows", [1, 7, 50, 5000])
@pytest.mark.parametrize("before,after", [(0, 0), (4, 0), (0, 3), (12, 9)])
def test_over_blocks(rows, block_rows, before, after):
    def columns(d, w):
        f = w.rowsBetween(-before, after)
        return d.withColumn("s", F.sum("x").over(f)).withColumn("k", F.count("x").over(f)).withColumn(
            "old", F.lag("x", before).over(w) if before else F.col("x"))

    got = B.over_blocks(rows, ["symbol"], "open_time", before, after, columns, cell_s=3600, block_rows=block_rows)
    same(got, columns(rows, W()))


def test_over_blocks_without_keys(rows):
    one = rows.where("symbol = 'hot'").drop("symbol")
    fn = lambda d, w: d.withColumn("p", F.lag("x").over(w))
    got = B.over_blocks(one, [], "open_time", 1, 0, fn, block_rows=9).withColumn("symbol", F.lit(""))
    same(got, fn(one, Window.orderBy("open_time")).withColumn("symbol", F.lit("")))


@pytest.mark.parametrize("cell_s", [60, 86_400])
def test_carry_last(rows, cell_s):
    got = B.carry_last(rows, ["symbol"], "open_time", "y", "z", cell_s=cell_s)
    want = rows.withColumn("z", F.last("y", ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0)))
    same(got, want)


def test_running_sum(rows):
    got = B.running_sum(rows, ["symbol"], "open_time", ["x"], cell_s=3600)
    same(got, rows.withColumn("x_sum", F.sum("x").over(W().rowsBetween(Window.unboundedPreceding, 0))))


@pytest.mark.parametrize("ranges", [2, 16])
def test_value_ranks(rows, ranges):
    got = B.value_ranks(rows, ["symbol"], "x", ranges).toPandas()
    p = rows.toPandas()
    for sym, g in p.groupby("symbol"):
        mine = got[got.symbol == sym].set_index("x")
        assert len(mine) == g.x.nunique()
        for v in g.x.unique():
            assert mine.n_less[v] == (g.x < v).sum() and mine.n_equal[v] == (g.x == v).sum()
            assert mine.n_group[v] == len(g)


def test_value_ranks_weighted_and_unkeyed(rows):
    counted = rows.groupBy("x").agg(F.count("*").alias("w"))
    got = B.value_ranks(counted, [], "x", weight="w").toPandas().set_index("x")
    x = rows.toPandas().x
    assert all(got.n_less[v] == (x < v).sum() for v in x.unique())


@pytest.mark.parametrize("cell_s", [60, 3600])
@pytest.mark.parametrize("lag_s,tolerance_s", [(0, None), (3600, None), (0, 7200)])
def test_asof(rows, cell_s, lag_s, tolerance_s):
    right = rows.where("y IS NOT NULL").select("symbol", F.col("open_time").alias("t"), F.col("y").alias("v"))
    left = rows.select("symbol", (F.col("open_time") + F.expr("INTERVAL 7 MINUTES")).alias("open_time"))
    got = asof_join(left, right, ["symbol"], "open_time", "t", ["v"], lag_s, tolerance_s, cell_s=cell_s).toPandas()
    pl, pr = left.toPandas(), right.toPandas()
    assert len(got) == len(pl)
    got = got.set_index(["symbol", "open_time"])
    for sym, t in pl.itertuples(index=False):
        c = pr[(pr.symbol == sym) & (pr.t + pd.Timedelta(seconds=lag_s) <= t)].sort_values("t")
        v = got.v[(sym, t)]
        best = c.iloc[-1] if len(c) else None
        if best is not None and tolerance_s is not None and (t - best.t).total_seconds() > tolerance_s:
            best = None
        assert (pd.isna(v) and best is None) or v == best.v


def test_interval_join(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    spans = spark.createDataFrame([("a", t(1), t(3), "x"), ("a", t(3), t(5), "y"), ("a", t(7), None, "z")], "k string, s timestamp_ntz, e timestamp_ntz, name string")
    points = spark.createDataFrame([("a", t(h)) for h in range(10)] + [("b", t(1))], "k string, at timestamp_ntz")
    got = {(r.at.hour): r.name for r in interval_join(points, spans, ["k"], "at", "s", "e").collect()}
    assert got == {1: "x", 2: "x", 3: "y", 4: "y", 7: "z", 8: "z", 9: "z"}
