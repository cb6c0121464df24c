"""Streams run over what is there (availableNow) and read back.

Append-mode windows that the watermark has not passed stay unemitted, so the
SQL twins keep the windows that ended before (newest time - delay).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from candlespark.plans.registry import query, r
from candlespark.plans.tables import BARS, MONITOR, PAIRS, TICKS, bars_1h, monitor_events, pairs, table
from candlespark.session import shared_dir
from candlespark.sources import snapshots
from candlespark.sources.bars import scan_bars
from candlespark.sources.events import scan_events
from candlespark.streaming import barrier as SB
from candlespark.streaming import bars as B
from candlespark.streaming import cache as C
from candlespark.streaming import live as L


def _events_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _tick_stream(spark, sf, delay):
    """Ticks as one-row bars with a watermark."""
    price = F.col("value")
    return _events_stream(spark, sf).select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("open_time"),
        *[price.alias(c) for c in ("open", "high", "low", "close")], F.get_json_object("props", "$.k").cast("double").alias("volume"),
        F.lit(1).cast("long").alias("n_trades"),
    ).withWatermark("open_time", delay)


def _run(spark, stream, name, mode="append"):
    path = shared_dir(spark, name)
    B.run_available(stream, path, path + "-state", mode)
    return spark.read.parquet(path)


def _ntz(df, *names):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in names else F.col(c) for c in df.columns])


def _messages(spark, *parts):
    """Bars as stream messages, one file per part, read in that order: each closed candle twice and once still open."""
    path = shared_dir(spark, "messages")
    for i, b in enumerate(parts):
        _write_messages(b, f"{path}/part={i}")
    return B.messages_from_files(spark, f"{path}/*", 1)


def _write_messages(b, path, sent=None):
    """``sent``: the time of each message in milliseconds."""
    txt = lambda c: F.col(c).cast("string")
    k = F.struct(
        F.col("symbol").alias("s"), F.unix_millis(F.col("open_time").cast("timestamp")).alias("t"), txt("open").alias("o"), txt("high").alias("h"),
        txt("low").alias("l"), txt("close").alias("c"), txt("volume").alias("v"), txt("quote_volume").alias("q"), F.col("n_trades").alias("n"), F.col("x"),
    )
    each = b.withColumn("x", F.explode(F.array(F.lit(True), F.lit(True), F.lit(False))))
    data = F.struct(k.alias("k")) if sent is None else F.struct(sent.alias("E"), k.alias("k"))
    each.select(F.to_json(F.struct(data.alias("data"))).alias("value")).coalesce(1).write.text(path)


@query("stream_closed_candles", f"WITH {BARS} SELECT symbol, open_time, {r('open', 'high', 'low', 'close', 'volume')}, n_trades FROM bars")
def _(spark, sf):
    """Messages in three files -> store: weeks-late candles are added, corrected ones replace what came before."""
    store, bars = shared_dir(spark, "store"), bars_1h(spark, sf)
    late, wrong = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-03", "2024-01-20"))
    first = bars.where(F.col("open_time") >= late).withColumn("close", F.when(F.col("open_time") >= wrong, -F.col("close")).otherwise(F.col("close")))
    newest = bars.where(F.col("open_time") >= wrong)
    stream = B.closed_bars(_messages(spark, first, newest, bars.where(F.col("open_time") < late)))
    B.run_batches(stream, B.upsert_batches(store, "live"), shared_dir(spark, "state"), mode="append")
    return scan_bars(spark, store).select("symbol", "open_time", "open", "high", "low", "close", "volume", "n_trades")


@query("stream_resumed", f"WITH {BARS} SELECT symbol, open_time, {r('close', 'volume')} FROM bars")
def _(spark, sf):
    """A stream that stops and goes on from its checkpoint, twice, the second time without news."""
    path, store, state, bars = shared_dir(spark, "messages"), shared_dir(spark, "store"), shared_dir(spark, "state"), bars_1h(spark, sf)
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    for i, part in enumerate((bars.where(F.col("open_time") < half), bars.where(F.col("open_time") >= half), None)):
        if part is not None:
            _write_messages(part, f"{path}/part={i}")
        stream = B.closed_bars(B.messages_from_files(spark, f"{path}/*", 1))
        B.run_batches(stream, B.upsert_batches(store, "live"), state, mode="append")
    return scan_bars(spark, store).select("symbol", "open_time", "close", "volume")


OVER_BACKFILL = f"""
WITH {BARS} SELECT symbol, open_time, {r("CASE WHEN open_time >= TIMESTAMP '2024-01-22' THEN -close WHEN open_time >= TIMESTAMP '2024-01-16' THEN close * 7 "
  "WHEN open_time >= TIMESTAMP '2024-01-10' THEN close * 9 ELSE close * 3 END AS close")} FROM bars"""


def over_backfill(spark, sf, backfill, sink):
    """Three backfills, a stream of corrections, a fourth backfill, and the same stream going on; the folder of the store."""
    path, store, state, bars = shared_dir(spark, "messages"), shared_dir(spark, "store"), shared_dir(spark, "state"), bars_1h(spark, sf)

    def since(day):
        return bars.where(F.col("open_time") >= F.lit(day).cast("timestamp_ntz"))

    def times(b, n):
        return b.withColumn("close", F.col("close") * n)

    def stream(part, i):
        # The larger, older copy of each correction arrives first.
        both = times(part, 100).withColumn("sent", F.lit(1).cast("long")).unionByName(part.withColumn("sent", F.lit(2).cast("long")))
        _write_messages(both, f"{path}/part={i}", F.col("sent"))
        messages = B.messages_from_files(spark, f"{path}/*", 1)
        B.run_batches(B.closed_bars(messages), sink(store, "live"), state, mode="append")

    for n in (1, 2, 3):
        backfill(times(bars, n), store, "live")
    stream(times(since("2024-01-10"), 9), 0)
    backfill(times(since("2024-01-16"), 7), store, "live")
    stream(times(since("2024-01-22"), -1), 1)
    return store


@query("stream_over_backfill", OVER_BACKFILL)
def _(spark, sf):
    """The last to write wins, backfill or stream, and in one batch the last to arrive."""
    store = over_backfill(spark, sf, B.upsert_bars, B.upsert_batches)
    return scan_bars(spark, store).select("symbol", "open_time", "close")


@query("stream_over_snapshots", OVER_BACKFILL)
def _(spark, sf):
    """The same in a table of immutable commits, compacted while the stream runs."""
    store = over_backfill(spark, sf, snapshots.upsert, lambda path, source: B.commit_batches(path, source, compact_at=5))
    return snapshots.scan(spark, store).select("symbol", "open_time", "close")


@query("stream_snapshots", f"WITH {BARS} SELECT open_time, count(*)::INTEGER AS n_symbols, {r('sum(close) AS close_total')} FROM bars GROUP BY 1")
def _(spark, sf):
    """A user's callback after each batch gets the bars of every open time together."""
    store, out = shared_dir(spark, "store"), shared_dir(spark, "snapshots")

    def after(bars, batch_id):
        total = F.aggregate("bars", F.lit(0.0), lambda a, b: a + b["close"])
        rows = B.snapshots(bars).select("open_time", F.size("bars").alias("n_symbols"), total.alias("close_total"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    B.run_batches(_hour_stream(spark, sf), B.upsert_batches(store, "live", after), shared_dir(spark, "state"), mode="append")
    return spark.read.option("basePath", out).parquet(out).drop("batch")


END = "(SELECT date_trunc('milliseconds', max(ts)) FROM events)"


@query("stream_resample", f"""
WITH {BARS} SELECT symbol, open_time, {r('open', 'high', 'low', 'close', 'volume')}, n_trades FROM bars
WHERE open_time + INTERVAL 1 HOUR <= {END} - INTERVAL 2 HOUR""")
def _(spark, sf):
    """Tumbling hourly bars, emitted once closed."""
    return _ntz(_run(spark, B.stream_resample(_tick_stream(spark, sf, "2 hours"), "1h"), "resample"), "open_time")


@query("stream_sliding_features", f"""
WITH {TICKS}, w AS (SELECT symbol, price, size, unnest([0, 1, 2, 3]) AS k, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS h FROM ticks),
x AS (SELECT *, h - to_hours(k) AS window_start FROM w)
SELECT symbol, window_start, window_start + INTERVAL 4 HOUR AS window_end, {r('avg(price) AS close_mean', 'stddev_pop(price) AS close_std', 'max(price) - min(price) AS price_range', 'sum(size) AS volume')}, count(*) AS n_bars
FROM x WHERE window_start + INTERVAL 4 HOUR <= {END} - INTERVAL 2 HOUR GROUP BY ALL""")
def _(spark, sf):
    """Four-hour windows sliding by one hour."""
    out = _run(spark, B.stream_sliding(_tick_stream(spark, sf, "2 hours"), "4 hours", "1 hour"), "sliding")
    return _ntz(out, "window_start", "window_end")


def _hour_stream(spark, sf):
    """Hourly bars as a stream: the bars written out and read as files."""
    path = shared_dir(spark, "bars")
    b = bars_1h(spark, sf)
    b.withColumn("open_time", F.col("open_time").cast("timestamp")).write.parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withWatermark("open_time", "0 seconds")


SYMBOLS = ("click", "error", "purchase", "signup", "view")
SEEN = BARS + """, s AS (SELECT open_time, list_sort(list(symbol)) AS syms FROM bars GROUP BY 1),
m AS (SELECT *, list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(syms, x))) AS missing FROM s)"""


@query("stream_barrier", f"""
WITH {SEEN} SELECT open_time, len(syms)::INTEGER AS n_symbols, len(missing) = 0 AS complete, array_to_string(missing, ',') AS missing FROM m
WHERE open_time + INTERVAL 1 MINUTE <= (SELECT max(open_time) FROM bars)""")
def _(spark, sf):
    """Open times past the watermark: complete or not, and who is missing."""
    out = _run(spark, SB.barrier(_hour_stream(spark, sf), SYMBOLS), "barrier")
    return _ntz(out.withColumn("missing", F.array_join("missing", ",")), "open_time")


@query("stream_barrier_timeout", f"""
WITH {SEEN} SELECT open_time, len(syms)::INTEGER AS n_symbols, len(missing) = 0 AS complete, array_to_string(missing, ',') AS missing FROM m
WHERE len(missing) = 0 OR open_time + INTERVAL 20 SECOND < (SELECT max(open_time) FROM bars)""")
def _(spark, sf):
    """Fires on completion, else at the timeout."""
    out = _run(spark, SB.eager_barrier(_hour_stream(spark, sf), SYMBOLS), "eager")
    return _ntz(out.withColumn("missing", F.array_join("missing", ",")), "open_time")


@query("stream_barrier_filled", f"""
WITH {SEEN}, w AS (SELECT open_time, unnest(missing) AS symbol FROM m WHERE open_time + INTERVAL 1 MINUTE <= (SELECT max(open_time) FROM bars))
SELECT w.symbol, w.open_time, {r('b.close AS close')}, true AS filled FROM w ASOF JOIN bars b ON w.symbol = b.symbol AND w.open_time >= b.open_time""")
def _(spark, sf):
    """Bars of the missing symbols taken from a static table of last known closes."""
    from candlespark.operators.resample import densify

    out = _run(spark, SB.barrier(_hour_stream(spark, sf), SYMBOLS), "barrier")
    bars = bars_1h(spark, sf)
    known = densify(bars.unionByName(_end_marks(bars)), "1h", how="ffill").select("symbol", "open_time", "close")
    return SB.fill_missing(_ntz(out, "open_time"), known)


def _end_marks(bars):
    """A NULL bar per symbol at the table's newest time, so that every grid reaches it."""
    last = bars.agg(F.max("open_time").alias("t")).first()["t"]
    marks = bars.select("symbol").distinct().withColumn("open_time", F.lit(last).cast("timestamp_ntz"))
    marks = marks.join(bars.select("symbol", "open_time"), ["symbol", "open_time"], "left_anti")
    return marks.select(*[F.col(c) if c in ("symbol", "open_time") else F.lit(None).cast(t).alias(c) for c, t in bars.dtypes])


@query("stream_hot_cache", f"""
WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM bars)
SELECT symbol, count(*)::INTEGER AS n_cached, min(open_time) AS first_time, max(open_time) AS last_time, {r('arg_max(close, open_time) AS last_close', 'avg(close) AS mean_close', 'sum(volume) AS volume')}
FROM k WHERE k <= 100 GROUP BY 1""")
def _(spark, sf):
    """The last 100 bars per symbol, kept as state."""
    path = shared_dir(spark, "cache")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    B.run_batches(C.hot_cache(_hour_stream(spark, sf), 100), keep, shared_dir(spark, "state"))
    rows = spark.read.option("basePath", path).parquet(path)
    newest = rows.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("symbol", "batch")]), "batch").alias("v"))
    names = ["n_cached", "first_time", "last_time", "last_close", "mean_close", "volume"]
    return _ntz(newest.select("symbol", *[f"v.{n}" for n in names]), "first_time", "last_time")


@query("stream_hot_cache_preloaded", f"""
WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM bars)
SELECT symbol, count(*)::INTEGER AS n_cached, min(open_time) AS first_time, max(open_time) AS last_time, {r('arg_max(open, open_time) AS last_open', 'arg_max(high, open_time) AS last_high',
  'arg_max(low, open_time) AS last_low', 'arg_max(close, open_time) + 1 AS last_close', 'max(high) AS max_high', 'min(low) AS min_low', 'avg(close) + 1.0 / count(*) AS mean_close', 'sum(volume) AS volume')},
  arg_max(n_trades, open_time) AS last_n_trades, sum(n_trades)::BIGINT AS n_trades
FROM k WHERE k <= 100 GROUP BY 1""")
def _(spark, sf):
    """The stream brings one corrected bar per symbol; the cache holds the 99 before it from the store, in its first batch."""
    store, path, bars = shared_dir(spark, "store"), shared_dir(spark, "cache"), bars_1h(spark, sf)
    B.upsert_bars(bars, store, "x")
    newest = bars.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in bars.columns if c != "symbol"]), "open_time").alias("v")).select("symbol", "v.*")
    _write_messages(newest.withColumn("close", F.col("close") + 1), f"{path}-messages")
    stream = B.closed_bars(B.messages_from_files(spark, f"{path}-messages"))

    def keep(batch, batch_id):
        if batch_id == 0:
            batch.write.mode("overwrite").parquet(path)

    B.run_batches(C.hot_cache(stream, 100, scan_bars(spark, store)), keep, shared_dir(spark, "state"))
    return _ntz(spark.read.parquet(path), "first_time", "last_time")


@query("stream_barrier_stalled", f"""
WITH {SEEN}, g AS (SELECT DISTINCT open_time FROM bars), f AS (SELECT g.open_time, s.symbol, b.open_time AS bar_time, b.close, b.n_trades
  FROM g CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS symbol) s ASOF LEFT JOIN bars b ON b.symbol = s.symbol AND g.open_time >= b.open_time),
a AS (SELECT open_time, count(*) FILTER (WHERE bar_time <> open_time) AS n_filled, sum(close) AS c, sum(n_trades)::BIGINT AS trades FROM f GROUP BY 1)
SELECT m.open_time, len(syms)::INTEGER AS n_symbols, len(missing) = 0 AS complete, array_to_string(missing, ',') AS missing, n_filled::INTEGER AS n_filled, {r('c AS close_total')}, trades FROM m JOIN a USING (open_time)""")
def _(spark, sf):
    """A feed that stops: every open time still fires, the incomplete ones by the clock, with the last bars of the missing symbols."""
    path, state = shared_dir(spark, "stalled"), shared_dir(spark, "state")
    fired = SB.clock_barrier(_hour_stream(spark, sf), SYMBOLS, timeout_s=2, freq="1h", keep=100_000)
    B.run_until_quiet(fired, lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}"), state, quiet_s=4)
    total = lambda c, zero: F.aggregate("bars", zero, lambda a, b: a + b[c])
    out = spark.read.option("basePath", path).parquet(path).select(
        "open_time", "n_symbols", "complete", F.array_join("missing", ",").alias("missing"), F.size(F.filter("bars", lambda b: b["filled"])).alias("n_filled"),
        total("close", F.lit(0.0)).alias("close_total"), total("n_trades", F.lit(0).cast("long")).alias("trades"),
    )
    return _ntz(out, "open_time")


@query("stream_event_sync", f"WITH {MONITOR} SELECT topic_id, address, event_id, event_type, {r('value_num')}, observed_at FROM mon")
def _(spark, sf):
    """Event log in three deliveries of files, with repeats in a later one and events days late; each is synced into the store when it is there, by a stream that goes on from its checkpoint."""
    path, store, state, e = *(shared_dir(spark, n) for n in ("events", "event-store", "state")), monitor_events(spark, sf)
    late = F.col("observed_at") < F.lit("2024-01-05").cast("timestamp_ntz")
    for i, part in enumerate((e.where(~late), e.where(~late).unionByName(e.where(~late)), e.where(late))):
        part.write.parquet(f"{path}/part={i}")
        stream = spark.readStream.schema(e.schema).parquet(f"{path}/*")
        B.run_batches(stream, L.sync_batches(store), state, mode="append")
    return scan_events(spark, store).select("topic_id", "address", "event_id", "event_type", "value_num", "observed_at")


@query("stream_live_accuracy", f"""
WITH {PAIRS}, w AS (SELECT symbol, time_bucket(INTERVAL 12 HOUR, open_time, TIMESTAMP '1970-01-01') AS window_start, y_true, y_pred FROM pairs
  WHERE time_bucket(INTERVAL 12 HOUR, open_time, TIMESTAMP '1970-01-01') + INTERVAL 12 HOUR <= (SELECT max(open_time) FROM pairs)),
g AS (SELECT symbol, window_start, count(*) FILTER (WHERE y_true <> 0) AS n, count(*) FILTER (WHERE y_true <> 0 AND sign(y_true) = sign(y_pred)) AS hits FROM w GROUP BY ALL)
SELECT symbol, window_start, n, hits, {r('hits / n AS da')}, coalesce(hits / n < 0.6, false) AS trigger FROM g""")
def _(spark, sf):
    """Hit rate per closed half day, with the gate."""
    path = shared_dir(spark, "pairs")
    pairs(spark, sf).withColumn("open_time", F.col("open_time").cast("timestamp")).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).withWatermark("open_time", "0 seconds")
    return _ntz(_run(spark, L.live_accuracy(stream, ["symbol"], "12 hours", 0.6), "accuracy"), "window_start")


@query("stream_late_corrections", f"""
WITH {BARS} SELECT symbol, date_trunc('day', open_time)::TIMESTAMP AS open_time, {r('max(high) AS high', 'min(low) AS low', 'last(close ORDER BY open_time) + 1 AS close', 'sum(volume) AS volume')}
FROM bars WHERE open_time >= TIMESTAMP '2024-01-10' AND open_time < TIMESTAMP '2024-01-13' GROUP BY ALL""")
def _(spark, sf):
    """A stream whose second file corrects old candles: they overwrite stored bars, and the days they touched come out again."""
    store, out, bars = shared_dir(spark, "store"), shared_dir(spark, "corrected"), bars_1h(spark, sf)
    late = bars.where("open_time >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND open_time < TIMESTAMP_NTZ '2024-01-13 00:00:00'")
    stream = B.closed_bars(_messages(spark, bars, late.withColumn("close", F.col("close") + 1)))

    def emit(batch, batch_id):
        B.corrections(batch, store, "live", "1d").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    B.run_batches(stream, B.upsert_batches(store, "live", emit), shared_dir(spark, "state"), mode="append")
    rows = spark.read.option("basePath", out).parquet(out)
    return rows.where("batch = 1").select("symbol", "open_time", "high", "low", "close", "volume")


@query("stream_live_scores", f"""
WITH {BARS}, l AS (SELECT symbol, open_time, close, volume, list(close) OVER w AS cl, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k,
   count(*) OVER (PARTITION BY symbol) AS nb FROM bars WHERE open_time > (SELECT max(open_time) FROM bars) + INTERVAL 1 MINUTE - INTERVAL 14 HOUR
   WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT symbol, open_time, {r('close AS current_price', 'list_avg(cl) / close - 1 AS prediction')} FROM l WHERE k = 1 AND nb >= 12 AND volume <> 0""")
def _(spark, sf):
    """Micro-batches scored on the newest windows, with the training feature code."""
    return _live_scores(spark, sf, "1h", 12)


@query("stream_live_scores_daily", f"""
WITH {BARS}, d AS (SELECT symbol, date_trunc('day', open_time)::TIMESTAMP AS open_time, last(close ORDER BY open_time) AS close, sum(volume) AS volume FROM bars
   WHERE open_time > (SELECT max(open_time) FROM bars) + INTERVAL 1 MINUTE - INTERVAL 122 HOUR GROUP BY ALL),
l AS (SELECT *, list(close) OVER w AS cl, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k, count(*) OVER (PARTITION BY symbol) AS nb FROM d
   WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT symbol, open_time, {r('close AS current_price', 'list_avg(cl) / close - 1 AS prediction')} FROM l WHERE k = 1 AND nb >= 5 AND volume <> 0""")
def _(spark, sf):
    """Daily windows: the look-back follows from the bar width and the number of bars."""
    return _live_scores(spark, sf, "1d", 5)


def _live_scores(spark, sf, freq, n):
    store, out = shared_dir(spark, "store"), shared_dir(spark, "scores")

    def score(rows):
        mean = F.aggregate(F.transform("window", lambda b: b["close"]), F.lit(0.0), lambda a, x: a + x) / n
        return rows.select("symbol", "open_time", "current_price", (mean - 1).alias("prediction"))

    fn = L.scoring_batches(store, "live", out, freq, n, score)
    B.run_batches(_hour_stream(spark, sf), fn, shared_dir(spark, "state"), mode="append")
    return spark.read.option("basePath", out).parquet(out).drop("batch")
