"""Landing, store, planning and feature rules."""

import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlespark.functions import arrays
from candlespark.functions.names import price_from_log_return, symbol_key, ticker
from candlespark.functions.times import interval_minutes
from candlespark.operators import features as X
from candlespark.operators import quality as Q
from candlespark.operators import splits as V
from candlespark.operators.resample import resample, resample_live
from candlespark.session import shared_dir
from candlespark.sources import bars as S
from candlespark.sources import payloads as P

NTZ = "timestamp_ntz"


def minute_ramp(spark, hours, symbol="a", start=dt.datetime(2024, 1, 1)):
    c = 50_000 + 0.1 * F.col("id")
    return spark.range(hours * 60).select(
        F.lit(symbol).alias("symbol"), (F.lit(start).cast(NTZ) + F.make_interval(mins=F.col("id").cast("int"))).alias("open_time"),
        c.alias("open"), (c + 5).alias("high"), (c - 5).alias("low"), c.alias("close"), F.lit(100.0).alias("volume"),
        (c * 100).alias("quote_volume"), F.lit(1).cast("long").alias("n_trades"),
    )


def test_intervals():
    assert [interval_minutes(x) for x in ("5m", "15min", "1h", "1d")] == [5, 15, 60, 1440]
    with pytest.raises(ValueError):
        interval_minutes("1x")


def test_kline_payload(spark):
    line = [1633017600000, "50000.0", "50100.0", "49900.0", "50050.0", "100.5", 1633017659999, "5000000.0", 1000, "1", "1", "0"]
    df = spark.createDataFrame([("BTC", json.dumps([line, ["bad"]]))], "symbol string, payload string")
    good, bad = sorted(P.land_klines(df).collect(), key=lambda r: r.open_time is None)
    assert (good.open, good.close, good.volume, good.quote_volume, good.n_trades) == (50000, 50050, 100.5, 5e6, 1000)
    assert good.open_time == dt.datetime(2021, 9, 30, 16) and bad.open_time is None and bad.open is None


def test_row_payloads(spark):
    nested = {"timestamp": "2026-01-01T00:00:00Z", "values": {"open": 100, "high": 110, "low": 90, "close": 105, "volume": 50}}
    flat = {"timestamp": "2026-01-01T00:01:00Z", "open": 67475.15, "high": 67515.47, "low": 67400.0}
    df = spark.createDataFrame([("a", json.dumps(nested)), ("a", json.dumps(flat))], "symbol string, payload string")
    a, b = P.land_rows(df).orderBy("open_time").collect()
    assert (a.open, a.close, a.volume, a.open_time) == (100, 105, 50, dt.datetime(2026, 1, 1))
    assert b.open == 67475.15 and np.isnan(b.close) and b.volume == 0 and b.n_trades == 0


def test_symbol_names(spark):
    r = spark.range(1).select(symbol_key(F.lit("BTC/USD: x-y")).alias("k"), ticker(F.lit("BTC/USD-T")).alias("t")).first()
    assert (r.k, r.t) == ("BTCUSDxy", "btcusdt")


def test_store_layout_and_idempotent_upsert(spark):
    path, bars = shared_dir(spark, "t"), minute_ramp(spark, 30, "BTC/USD")
    S.upsert_bars(bars, path, "x", seq=1)
    S.upsert_bars(bars, path, "x", seq=1)
    assert os.path.isdir(f"{path}/source=x/symbol_key=BTCUSD/dt=2024-01-02")
    assert S.scan_bars(spark, path).count() == 1800
    part = S.scan_bars(spark, path, ["BTC/USD"], "2024-01-01 10:00", "2024-01-01 11:00")
    assert part.count() == 61
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "symbol_key" in plan.split("PartitionFilters")[1][:400] and "PushedFilters: [Is" in plan


def test_reconcile(spark):
    df = spark.createDataFrame([("a", 1.0, 7)], "symbol string, close double, trades_done int")
    r = S.reconcile(df).first()
    assert r.n_trades == 7 and r.quote_volume is None and len(r) == 9


def test_chunks(spark):
    d = spark.createDataFrame([(dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 10))], f"from_time {NTZ}, to_time {NTZ}")
    a, b = Q.chunk_ranges(d, 30).orderBy("chunk_start").collect()
    assert (a.chunk_end, b.chunk_start, b.chunk_end) == (dt.datetime(2026, 1, 31), dt.datetime(2026, 1, 31, 0, 0, 1), dt.datetime(2026, 2, 10))


def test_whole_history_request(spark):
    want = spark.createDataFrame([("a",), ("new",)], "symbol string")
    plan = Q.first_request(want, minute_ramp(spark, 1), "2020-01-01", F.lit(dt.datetime(2024, 2, 1)).cast(NTZ))
    assert [(r.symbol, r.kind) for r in plan.collect()] == [("new", "full")]


def test_resample_keeps_volume(spark):
    bars = minute_ramp(spark, 50)
    fine = resample(bars, "15m")
    assert fine.agg(F.sum("volume")).first()[0] == 50 * 60 * 100 and fine.count() == 200
    first = fine.orderBy("open_time").first()
    assert (first.open, first.close, first.high) == (50_000, pytest.approx(50_001.4), pytest.approx(50_006.4))


def test_live_bars_end_at_the_newest_row(spark):
    bars = minute_ramp(spark, 3).where("open_time < TIMESTAMP_NTZ '2024-01-01 02:08:00'")
    last = resample_live(bars, "5m", F.lit(dt.datetime(2024, 1, 1, 2, 8)).cast(NTZ)).orderBy(F.desc("open_time")).first()
    assert last.open_time == dt.datetime(2024, 1, 1, 2, 3) and last.n_trades == 5
    open_minute = resample_live(bars, "5m", F.lit(dt.datetime(2024, 1, 1, 2, 7, 30)).cast(NTZ)).orderBy(F.desc("open_time")).first()
    assert open_minute.open_time == dt.datetime(2024, 1, 1, 2, 2)


def test_live_row_equals_training_row(spark):
    bars = minute_ramp(spark, 72).unionByName(minute_ramp(spark, 5, "short"))
    now = dt.datetime(2024, 1, 4)
    live = {r.symbol: r for r in X.live_features(bars, "1h", 48, F.lit(now).cast(NTZ)).collect()}
    assert live["a"].enough and len(live["a"].window) == 48 and live["a"].current_price > 0
    assert "short" not in live or not live["short"].enough
    train = X.training_table(bars, "1h", 48, 1).where("symbol = 'a'").orderBy(F.desc("open_time")).first()
    assert train.open_time == live["a"].open_time and train.window == live["a"].window and train.target is None
    wide = X.widen(X.training_table(bars, "1h", 48, 1), 48)
    assert [c for c in wide.columns if c.startswith("feature_")] == X.feature_names(48) and len(X.feature_names(48)) == 240


def test_features_scale_back_to_history(spark):
    bars = minute_ramp(spark, 30)
    rows = X.training_table(bars, "1h", 4, 2).orderBy("open_time").collect()
    for i, r in enumerate(rows):
        if i < 3:
            assert r.window is None
            continue
        assert r.window[-1].close == 1.0
        for k in range(4):
            assert r.window[k].close * r.close == pytest.approx(rows[i - 3 + k].close, rel=1e-12)
        if i + 2 < len(rows):
            assert r.target == pytest.approx(np.log(rows[i + 2].close / r.close), rel=1e-9)


def test_unusable_last_bar_has_no_window(spark):
    bars = minute_ramp(spark, 10).withColumn("volume", F.when(F.hour("open_time") == 7, 0.0).otherwise(F.col("volume")))
    rows = {r.open_time.hour: r.window for r in X.window_features(resample(bars, "1h"), 3).collect()}
    assert rows[7] is None and rows[8] is not None


def test_raw_columns_are_refused(spark):
    with pytest.raises(ValueError):
        X.model_inputs(minute_ramp(spark, 1), ["close"])


@pytest.mark.parametrize("n", [8, 15, 26, 40])
def test_macd_weights(n):
    rng = np.random.default_rng(n)
    c = rng.normal(size=n) + 10

    def ema(x, p):
        out = [np.mean(x[: min(p, len(x))])]
        for v in x[1:]:
            out.append(v * 2 / (p + 1) + out[-1] * (1 - 2 / (p + 1)))
        return np.array(out)

    line, signal = (float(np.dot(w, c)) for w in arrays.macd_weights(n))
    if n < 12:
        assert line == signal == 0
    elif n < 26:
        assert line == pytest.approx(ema(c, 12)[-1] - c[0]) and signal == 0
    else:
        m = ema(c, 12) - ema(c, 26)
        assert line == pytest.approx(m[-1]) and signal == pytest.approx(ema(m, 9)[-1])
    assert float(np.dot(arrays.ema_weights(n, 5), c)) == pytest.approx(ema(c, 5)[-1])


def test_price_guard(spark):
    df = spark.createDataFrame([(100.0, 0.1), (0.0, 0.1), (100.0, float("nan")), (100.0, 1e9)], "p double, r double")
    got = [r[0] for r in df.select(price_from_log_return("p", "r")).collect()]
    assert got == [pytest.approx(100 * np.exp(0.1)), None, None, None]


def test_fold_table():
    gap = V.purge_gap(24, [48, 12], margin=2)
    assert gap == 50
    folds = V.fold_table(1000, 100, 3, gap, train_size=300)
    for f, tl, th, vl, vh, el, eh in folds:
        assert vl - th == gap and el - vh == gap and vh - vl == eh - el == 100 and th - tl == 300
    assert folds[-1][-1] == 1000 and V.folds_for_budget(300, 100) == 3
    with pytest.raises(ValueError):
        V.fold_table(100, 50, 2, 10)


def test_custom_features(spark):
    X.register_feature("double_close", lambda d: d.withColumn("double_close", F.col("close") * 2))
    r = X.apply_features(minute_ramp(spark, 1), ["double_close"]).first()
    assert r.double_close == r.close * 2
