"""The candle data source against the landing job, in batch and as a stream that stops and goes on."""

import json
import os

from pyspark.sql import functions as F

from candlespark.session import shared_dir
from candlespark.sources import payload_source as PS
from candlespark.sources.payloads import land_klines
from candlespark.streaming import bars as B


def candle(minute, close, n="3"):
    t = 1_704_067_200_000 + minute * 60_000
    return [t, "1.5", "2.5", "0.5", str(close), "10", t + 59_999, "15", n, "0", "0", "0"]


def put(path, symbol, name, payload, at):
    folder = f"{path}/symbol={symbol.replace('/', '%2F')}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.write(payload if isinstance(payload, str) else json.dumps(payload))
    os.utime(f"{folder}/{name}.json", (1_700_000_000 + at, 1_700_000_000 + at))


ODD = [[candle(0, 1)], [candle(1, "no number", n=None), [1], [], "x", None, ["?", "1"]], "not json", "{}", "[]", [candle(2, 7, n=2.0)]]


def rows(df):
    names = ["symbol", "open_time", "open", "high", "low", "close", "volume", "quote_volume", "n_trades"]
    return sorted(map(str, (tuple(r) for r in df.select(*names).collect())))


def test_batch_equals_the_landing_job(spark):
    PS.register(spark)
    path = shared_dir(spark, "candles")
    payloads = [("BTC/USD", [candle(m, m) for m in range(50)]), ("ETHUSD", [candle(m, 2 * m) for m in range(30)])]
    for i, (symbol, p) in enumerate(payloads):
        put(path, symbol, f"p{i}", p, i)
    df = spark.createDataFrame([(s, json.dumps(p)) for s, p in payloads], "symbol string, payload string")
    read = spark.read.format("candles").option("path", path).option("files", 1).load()
    assert rows(read) == rows(land_klines(df, ntz=False)) and read.rdd.getNumPartitions() == 2
    assert {r.file for r in read.select("file").distinct().collect()} == {"symbol=BTC%2FUSD/p0.json", "symbol=ETHUSD/p1.json"}


def test_odd_payloads(spark):
    """Broken text, other shapes and missing values; and a folder without files."""
    PS.register(spark)
    path = shared_dir(spark, "candles")
    for i, p in enumerate(ODD):
        put(path, "a", f"p{i}", p, i)
    got = [(r.open_time and r.open_time.minute, r.close, r.n_trades) for r in spark.read.format("candles").load(path).orderBy("file", F.col("open_time").asc_nulls_last()).collect()]
    assert got[0] == (0, 1.0, 3) and (1, None, None) in got and got[-1] == (2, 7.0, None)
    assert len(got) == 1 + 4 + 1
    empty = shared_dir(spark, "candles")
    os.makedirs(empty)
    assert spark.read.format("candles").load(empty).count() == 0


def test_stream_goes_on_where_it_stopped(spark):
    """Three runs from one checkpoint, the last without news: each payload once, and the store as by the batch job."""
    PS.register(spark)
    path, out, state = (shared_dir(spark, n) for n in ("candles", "out", "state"))
    for run in range(3):
        if run < 2:
            for s in "ab":
                put(path, s, f"p{run}", [candle(10 * run + m, run) for m in range(10)], 10 + run)
        stream = spark.readStream.format("candles").option("path", path).option("files", 1).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="100 milliseconds")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        assert spark.read.parquet(out).count() == 20 * min(run + 1, 2)
    assert rows(spark.read.parquet(out)) == rows(spark.read.format("candles").load(path))


def test_source_feeds_the_store(spark):
    """A later payload of the same candle wins by its file's time, also within one batch."""
    from candlespark.sources.bars import scan_bars, upsert_bars

    PS.register(spark)
    path, store = shared_dir(spark, "candles"), shared_dir(spark, "store")
    put(path, "a", "z-first", [candle(0, 9, n="99")], 1)
    put(path, "a", "a-second", [candle(0, 4, n="1")], 2)
    upsert_bars(B.as_batch(spark.read.format("candles").load(path)), store, "x")
    assert [r.close for r in scan_bars(spark, store).collect()] == [4.0]
