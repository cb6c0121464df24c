"""Streams over several batches, restarts and late rows."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from candlespark.session import shared_dir
from candlespark.sources.bars import scan_bars
from candlespark.streaming import barrier as SB
from candlespark.streaming import bars as B
from candlespark.streaming import cache as C


def message(symbol, minute, close, closed=True, day=1):
    t = int(dt.datetime(2024, 1, day, tzinfo=dt.timezone.utc).timestamp() * 1000) + minute * 60_000
    c = str(close)
    return json.dumps({"data": {"k": {"s": symbol, "t": t, "o": c, "h": c, "l": c, "c": c, "v": "1", "q": "1", "n": 1, "x": closed}}})


def drop(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.write("\n".join(lines))


def test_restart_and_late_rows(spark):
    src, store, state = (shared_dir(spark, n) for n in ("src", "store", "state"))
    drop(src, "1", [message("a", m, m) for m in range(5)] + [message("a", 5, 99, closed=False)])
    run = lambda: B.run_batches(B.closed_bars(B.messages_from_files(spark, src, 1)), B.upsert_batches(store, "x"), state, "append")
    run()
    assert scan_bars(spark, store).count() == 5
    drop(src, "2", [message("a", m, m) for m in range(3, 9)])
    run()
    run()
    got = {r.open_time.minute: r.close for r in scan_bars(spark, store).collect()}
    assert got == {m: m for m in range(9)}


def test_very_late_and_corrected_candles(spark):
    """A candle an hour behind all others is stored, and the newer copy of a candle wins."""
    src, store, state = (shared_dir(spark, n) for n in ("src", "store", "state"))
    drop(src, "1", [message("a", m, m) for m in range(50, 62)])
    drop(src, "2", [message("a", m, m) for m in range(62, 120)])
    drop(src, "3", [message("a", 5, 5), message("a", 61, 9)])
    for i in range(1, 4):
        os.utime(f"{src}/{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    B.run_batches(B.closed_bars(B.messages_from_files(spark, src, 1)), B.upsert_batches(store, "x"), state, "append")
    got = {r.open_time.minute + 60 * r.open_time.hour: r.close for r in scan_bars(spark, store).collect()}
    assert got == {5: 5.0, **{m: float(m) for m in range(50, 120)}, 61: 9.0}


def test_short_histories_are_reported(spark):
    from candlespark.streaming.live import scoring_batches

    store, out = shared_dir(spark, "store"), shared_dir(spark, "scores")
    rows = [(s, dt.datetime(2024, 1, d), float(d), 1.0) for s, days in (("a", range(1, 8)), ("b", range(6, 8))) for d in days]
    bars = spark.createDataFrame(rows, "symbol string, open_time timestamp, close double, volume double")
    for c in ("open", "high", "low"):
        bars = bars.withColumn(c, F.col("close"))
    scoring_batches(store, "x", out, "1d", 5, lambda r: r.select("symbol", "current_price"))(bars, 0)
    assert [tuple(r) for r in spark.read.parquet(f"{out}/batch=0").collect()] == [("a", 7.0)]
    assert [(r.symbol, r.enough) for r in spark.read.parquet(f"{out}-short/batch=0").collect()] == [("b", False)]


def test_repeated_batch_changes_nothing(spark):
    store = shared_dir(spark, "store")
    bars = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1.0)], "symbol string, open_time timestamp, close double")
    fn = B.upsert_batches(store, "x")
    fn(bars, 0)
    fn(bars, 0)
    fn(bars.withColumn("close", F.lit(2.0)), 1)
    assert [r.close for r in scan_bars(spark, store).collect()] == [2.0]


def test_barrier_fires_once_and_times_out(spark):
    src, out, state = (shared_dir(spark, n) for n in ("src", "out", "state"))
    drop(src, "1", [message("a", 0, 1), message("a", 1, 1), message("b", 1, 1)])
    drop(src, "2", [message("b", 0, 1), message("a", 2, 1), message("zz", 2, 1)])
    drop(src, "3", [message("a", 0, 1), message("a", 30, 1), message("b", 30, 1)])
    drop(src, "4", [message("a", 60, 1), message("b", 60, 1)])
    for i in range(1, 5):
        os.utime(f"{src}/{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    bars = B.land_stream_klines(B.messages_from_files(spark, src, 1)).withWatermark("open_time", "10 minutes")
    B.run_available(SB.eager_barrier(bars, ["a", "b"], timeout_s=20), out, state)
    got = sorted((r.open_time.minute + 60 * r.open_time.hour, r.complete, tuple(r.missing)) for r in spark.read.parquet(out).collect())
    assert got == [(0, True, ()), (1, True, ()), (2, False, ("b",)), (30, True, ()), (60, True, ())]


def test_hot_cache_replaces_and_bounds(spark):
    src, state = shared_dir(spark, "src"), shared_dir(spark, "state")
    drop(src, "1", [message("a", m, m) for m in range(6)])
    drop(src, "2", [message("a", 5, 50), message("a", 6, 6)])
    for i in (1, 2):
        os.utime(f"{src}/{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    seen = {}

    def keep(batch, batch_id):
        for r in batch.collect():
            seen[batch_id] = (r.n_cached, r.last_close, r.mean_close)

    bars = B.land_stream_klines(B.messages_from_files(spark, src, 1))
    B.run_batches(C.hot_cache(bars, 3), keep, state)
    assert seen == {0: (3, 5.0, 4.0), 1: (3, 6.0, pytest.approx((4 + 50 + 6) / 3))}


def test_stream_bars_equal_batch_bars(spark):
    src, out, state = (shared_dir(spark, n) for n in ("src", "out", "state"))
    for i in range(4):
        drop(src, str(i), [message("a", m, m % 7) for m in range(i * 30, i * 30 + 30)])
        os.utime(f"{src}/{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    bars = B.closed_bars(B.messages_from_files(spark, src, 1)).withWatermark("open_time", "1 minute")
    B.run_available(B.stream_resample(bars, "15m"), out, state)
    from candlespark.operators.resample import resample

    land = B.land_stream_klines(spark.read.text(src))
    want = {r.open_time: (r.open, r.high, r.low, r.close, r.volume) for r in resample(land, "15m").collect()}
    got = {r.open_time: (r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(out).collect()}
    assert len(got) >= 6 and all(want[t] == v for t, v in got.items())


def test_snapshots(spark):
    bars = spark.createDataFrame([("b", 1, 2.0), ("a", 1, 1.0), ("a", 2, 3.0)], "symbol string, open_time int, close double")
    got = {r.open_time: [x.symbol for x in r.bars] for r in B.snapshots(bars).collect()}
    assert got == {1: ["a", "b"], 2: ["a"]}


def test_synced_deliveries_are_written_in_parallel(spark, small, tmp_path, monkeypatch):
    """An event log in several files is not drawn into one task on its way to the store."""
    from candlespark.plans import stream_queries as Q
    from candlespark.plans.catalogue import QUERIES

    log = spark.read.parquet(f"{small}/events.parquet")
    log.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    made = {}
    monkeypatch.setattr(Q, "shared_dir", lambda s, name: made.setdefault(name, shared_dir(s, name)))
    got = QUERIES["stream_event_sync"](spark, str(tmp_path))
    assert got.count() == got.select("event_id").distinct().count() == log.count()
    for i in range(3):
        assert len([n for n in os.listdir(f"{made['events']}/part={i}") if n.endswith(".parquet")]) >= 4
