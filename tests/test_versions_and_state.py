"""The clock of the bar store, whole bars in state, and barriers that fire by the clock."""

import datetime as dt
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from candlespark.session import shared_dir
from candlespark.sources import bars as S
from candlespark.sources import versions as V
from candlespark.streaming import barrier as SB
from candlespark.streaming import bars as B
from candlespark.streaming import cache as C


def bars(spark, close, days=(1, 2), **more):
    rows = [("a", dt.datetime(2024, 1, d), float(close)) for d in days]
    df = spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, close double")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def closes(spark, store):
    return {r.open_time.day: r.close for r in S.scan_bars(spark, store).collect()}


def message(symbol, minute, close, sent=None, n=1):
    t = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000) + minute * 60_000
    k = {"s": symbol, "t": t, "o": str(close - 1), "h": str(close + 2), "l": str(close - 3), "c": str(close), "v": "2", "q": "1", "n": n, "x": True}
    return json.dumps({"data": {"k": k} if sent is None else {"E": sent, "k": k}})


def drop(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.write("\n".join(lines))
    os.utime(f"{folder}/{name}.json", (1_700_000_000 + int(name), 1_700_000_000 + int(name)))


# ---------------------------------------------------------------- versions
def test_the_last_writer_wins(spark):
    """Backfills, two streams and a backfill between the batches of one of them."""
    store = shared_dir(spark, "store")
    for close in (1, 2, 3):
        S.upsert_bars(bars(spark, close), store, "x")
    one, two = B.upsert_batches(store, "x"), B.upsert_batches(store, "x")
    one(bars(spark, 9, [1]), 0)
    assert closes(spark, store) == {1: 9.0, 2: 3.0}
    S.upsert_bars(bars(spark, 4), store, "x")
    one(bars(spark, 9, [1]), 0)  # a repetition is no news
    assert closes(spark, store) == {1: 4.0, 2: 4.0}
    one(bars(spark, 5, [1]), 1)
    two(bars(spark, 6, [2]), 0)
    assert closes(spark, store) == {1: 5.0, 2: 6.0}


def test_versions_by_hand_move_the_clock(spark):
    store = shared_dir(spark, "store")
    S.upsert_bars(bars(spark, 1), store, "x", seq=41)
    S.upsert_bars(bars(spark, 2), store, "x")
    assert closes(spark, store) == {1: 2.0, 2: 2.0}
    S.upsert_bars(bars(spark, 3), store, "x", seq=40)
    assert closes(spark, store) == {1: 2.0, 2: 2.0}
    S.upsert_bars(bars(spark, 7, v=90), store, "x", seq=F.col("v"))
    S.upsert_bars(bars(spark, 8), store, "x")
    assert closes(spark, store) == {1: 8.0, 2: 8.0} and V.newest(spark, store) == 91


def test_store_without_clock_goes_on_from_its_rows(spark):
    """A store whose rows were written before there was a clock."""
    store, other = shared_dir(spark, "store"), shared_dir(spark, "other")
    S.upsert_bars(bars(spark, 1), other, "x", seq=17)
    spark.read.schema(S.STORED).parquet(other).write.partitionBy(*S.PARTITIONS).parquet(store)
    assert V.newest(spark, store) == 0
    S.upsert_bars(bars(spark, 2, [2]), store, "x")
    assert closes(spark, store) == {1: 1.0, 2: 2.0} and V.newest(spark, store) == 18


def test_ticks_are_claimed_once(spark):
    store = shared_dir(spark, "store")
    with ThreadPoolExecutor(8) as pool:
        ticks = list(pool.map(lambda i: V.claim(spark, store, f"w{i % 4}", i), range(40)))
    assert sorted(ticks) == list(range(1, 41))
    assert [V.claim(spark, store, f"w{i % 4}", i) for i in range(40)] == ticks
    for i in range(3 * V.KEPT):
        V.claim(spark, store, "w0", 100 + i)
    assert len(V._names(spark, f"{store}/{V.CLOCK}/clock")) <= V.KEPT and len(V._names(spark, f"{store}/{V.CLOCK}/writers/w0")) <= V.KEPT


def test_last_to_arrive_wins_within_a_batch(spark):
    """A correction downwards, with fewer trades, sent later."""
    src, store, state = (shared_dir(spark, n) for n in ("src", "store", "state"))
    drop(src, "1", [message("a", 0, 5, sent=20, n=1), message("a", 0, 9, sent=10, n=7), message("a", 1, 3, n=1), message("a", 1, 2, n=4)])
    B.run_batches(B.closed_bars(B.messages_from_files(spark, src)), B.upsert_batches(store, "x"), state, "append")
    assert {r.open_time.minute: r.close for r in S.scan_bars(spark, store).collect()} == {0: 5.0, 1: 2.0}


# ------------------------------------------------------------------- cache
def test_preloaded_cache_holds_whole_bars(spark):
    store, src, state = (shared_dir(spark, n) for n in ("store", "src", "state"))
    B.land_stream_klines(spark.createDataFrame([(message("a", m, m + 10, n=m),) for m in range(8)], "value string")).createOrReplaceTempView("before")
    S.upsert_bars(B.as_batch(spark.table("before")), store, "x")
    drop(src, "1", [message("a", 7, 50, sent=9, n=1), message("a", 7, 60, sent=8, n=99), message("a", 8, 1, n=3)])
    drop(src, "2", [message("a", 8, 2, sent=5), message("b", 0, 4)])
    drop(src, "3", [message("a", 8, 7, sent=4)])
    seen = {}

    def keep(batch, i):
        for r in batch.collect():
            seen.setdefault(i, []).append((r.symbol, r.open_time.minute, r.open, r.high, r.low, r.close, r.n_trades))

    messages = B.closed_bars(B.messages_from_files(spark, src, 1))
    B.run_batches(C.hot_cache(messages, 4, S.scan_bars(spark, store), rows=True), keep, state)
    whole = lambda s, m, c, n: (s, m, c - 1.0, c + 2.0, c - 3.0, float(c), n)
    old = [whole("a", 5, 15, 5), whole("a", 6, 16, 6), whole("a", 7, 50, 1)]
    assert sorted(seen[0]) == [*old, whole("a", 8, 1, 3)]
    assert sorted(seen[1]) == [*old, whole("a", 8, 2, 1), whole("b", 0, 4, 1)]
    assert sorted(seen[2]) == [*old, whole("a", 8, 2, 1)]  # sent before the copy it holds


# ----------------------------------------------------------------- barrier
def test_barrier_fires_when_the_feed_stops(spark):
    """Completed times fire at once, the rest by the clock, with bars from the state; each once."""
    src, state = shared_dir(spark, "src"), shared_dir(spark, "state")
    drop(src, "1", [message(s, 0, 10 + i) for i, s in enumerate("abc")] + [message("a", 1, 20), message("b", 1, 21), message("zz", 1, 0)] + [message("a", 2, 30)])
    fired = []

    def keep(batch, i):
        for r in batch.collect():
            fired.append((r.open_time.minute, r.complete, r.missing, {b.symbol: (b.close, b.bar_time.minute, b.filled) for b in r.bars}))

    bars_ = B.land_stream_klines(B.messages_from_files(spark, src, 1))
    B.run_until_quiet(SB.clock_barrier(bars_, ["a", "b", "c"], timeout_s=1), keep, state, quiet_s=3, limit_s=90)
    assert sorted(fired, key=lambda f: f[0]) == [
        (0, True, [], {"a": (10.0, 0, False), "b": (11.0, 0, False), "c": (12.0, 0, False)}),
        (1, False, ["c"], {"a": (20.0, 1, False), "b": (21.0, 1, False), "c": (12.0, 0, True)}),
        (2, False, ["b", "c"], {"a": (30.0, 2, False), "b": (21.0, 1, True), "c": (12.0, 0, True)}),
    ]


class Values:
    """A named state of the barrier, as a dictionary."""

    def __init__(self):
        self.held = {}

    def iterator(self):
        return iter(list(self.held.items()))

    def containsKey(self, k):
        return k in self.held

    def getValue(self, k):
        return self.held[k]

    def updateValue(self, k, v):
        self.held[k] = v

    def removeKey(self, k):
        self.held.pop(k, None)


class Clock:
    """The processor's handle and the clock of the test."""

    def __init__(self):
        self.now, self.timers, self.states = 0, [], {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Values())

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.now


def rows_of(*bars_):
    import pandas as pd

    names = ["symbol", "us", "open", "high", "low", "close", "volume", "quote_volume", "n_trades", "arrival"]
    return pd.DataFrame([(s, m * 60_000_000, c, c, c, c, 1.0, None, 1, None) for s, m, c in bars_], columns=names)


def test_barrier_by_an_injected_clock():
    clock, barrier = Clock(), SB.ClockBarrier(["a", "b"], 20, 60_000_000, keep=3)
    barrier.init(clock)

    def told(frames):
        return [(r.open_time.minute, r.complete, [(b[0], b[2], b[6]) for b in r.bars]) for f in frames for r in f.itertuples(index=False)]

    def came(*bars_):
        return told(barrier.handleInputRows(("",), iter([rows_of(*bars_)]), clock))

    def waited(ms):
        clock.now += ms
        return told(barrier.handleExpiredTimer(("",), clock, clock)) if clock.now in clock.timers else []

    assert came(("a", 0, 1.0)) == [] and waited(19_999) == []
    assert waited(1) == [(0, False, [("a", False, 1.0)])]
    assert came(("b", 0, 2.0)) == []  # fired once, but remembered
    assert came(("b", 1, 3.0)) == [] and waited(20_000) == [(1, False, [("a", True, 1.0), ("b", False, 3.0)])]
    assert came(("a", 2, 4.0)) == []
    assert came(("b", 2, 5.0)) == [(2, True, [("a", False, 4.0), ("b", False, 5.0)])]
    # Open times beyond ``keep`` leave the state; rows older than that are dropped.
    assert came(("a", 3, 6.0), ("a", 4, 6.0)) == [] and sorted(k[0] // 60_000_000 for k in barrier.times.held) == [2, 3, 4]
    assert came(("a", 0, 9.0), ("b", 0, 9.0)) == [] and len(barrier.times.held) == 3
    assert {k[0] // 60_000_000 for k in barrier.bars.held} == {2, 3, 4}
    assert came(("a", 5, 7.0), ("a", 6, 7.0)) == [(3, False, [("a", False, 6.0), ("b", True, 5.0)])]
    assert waited(20_000)[0][0] == 4


@pytest.mark.parametrize("new, old, want", [((1, 5), (2, 4), True), ((1, 3), (2, 4), False), ((1, None), (2, 4), True), ((1, 3), (2, None), True), ((1, 3), None, True)])
def test_later_copy(new, old, want):
    assert C.later(new, old) == want
