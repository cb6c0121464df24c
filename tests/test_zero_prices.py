"""Bars that hold a price of 0, against the SQL twins."""

import datetime as dt
import math

import duckdb
import pytest

from compare import check
from candlespark.operators import gates as G
from candlespark.plans.catalogue import QUERIES

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """30 hours of two ticks each: low 0 in hour 3, close 0 in hours 26 and 27, nothing but 0 in hour 27."""
    path = str(tmp_path_factory.mktemp("zeros"))
    price = lambda h, i: 0.0 if (h, i) in {(3, 0), (26, 1), (27, 0), (27, 1)} else 10.0 + h % 5 + i
    rows = [(2 * h + i, START + dt.timedelta(hours=h, minutes=i), 1, "view", price(h, i), '{"k": 3}') for h in range(30) for i in range(2)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return path, con


def test_combined_subpredictions(spark, zeros):
    path, con = zeros
    assert check(spark, con, "combined_subpredictions", path).startswith("ok")
    got = {(r.open_time - START).seconds // 3600 + 24 * (r.open_time - START).days: r for r in QUERIES["combined_subpredictions"](spark, path).collect()}
    assert got[3].by_sum == got[3].by_weight == math.inf and math.isnan(got[3].by_product)
    assert math.isnan(got[27].by_sum) and math.isnan(got[27].by_weight) and math.isnan(got[27].by_product)
    assert len(got) == 30 and all(math.isfinite(got[h].by_sum) for h in got if h not in (3, 26, 27))


def test_realised_variance(spark, zeros):
    """The undefined range of hour 3 and the undefined steps after hour 25 are left out, by the query and by its twin."""
    path, con = zeros
    assert check(spark, con, "realised_variance", path).startswith("ok")
    got = sorted((r.open_time, r.realised_var, r.range_vol) for r in QUERIES["realised_variance"](spark, path).collect())
    low = [10.0 + h % 5 for h in range(30)]
    ranges = [math.log((p + 1) / p) for h, p in enumerate(low) if h != 3]
    assert got[23][2] == pytest.approx(sum(ranges[:23]) / 23, abs=1e-6) and got[22][2] is None
    steps = [math.log((low[h] + 1) / (low[h - 1] + 1)) ** 2 for h in range(1, 26)]
    assert got[24][1] == pytest.approx(sum(steps[:24]), abs=1e-6) and got[23][1] is None
    assert got[28][1] == pytest.approx(sum(steps[4:25]), abs=1e-6)
    assert all(math.isfinite(x) for row in got[24:] for x in row[1:])


def test_product_is_not_rounded_by_logarithms(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 7.0), (1, -11.0)], "k int, y_pred double")
    assert G.combine(df, ["k"], "product").first().y_pred == -231.0


@pytest.mark.parametrize("parts, want", [
    ([2.0, -3.0], -6.0), ([0.0, -3.0], 0.0), ([float("inf"), -2.0], -math.inf), ([0.0, float("inf")], math.nan), ([0.0, float("nan")], math.nan), ([0.0, None], 0.0), ([None], None)])
def test_product_of_parts(spark, parts, want):
    df = spark.createDataFrame([(1, v) for v in parts], "k int, y_pred double")
    got = G.combine(df, ["k"], "product").first().y_pred
    assert got is None if want is None else got == pytest.approx(want, nan_ok=True)
