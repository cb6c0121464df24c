"""Resampling, window features, indicators and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlespark.functions.safe import ln
from candlespark.operators import features as X
from candlespark.operators import resample as R
from candlespark.operators.asof import asof_join
from candlespark.operators.blocks import MINUTE as TICK_CELL
from candlespark.plans.registry import query, r
from candlespark.plans.tables import BARS, BARS_1D, MONTH, TICKS, YEAR, bars_1d, bars_1h, bars_sql, ticks

OHLC = ("open", "high", "low", "close", "volume", "quote_volume")
W = "WINDOW w AS (PARTITION BY symbol ORDER BY open_time)"


def last(k: int) -> str:
    return f"(PARTITION BY symbol ORDER BY open_time ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


# -------------------------------------------------------------- resampling
@query("bars_1h", f"WITH {BARS} SELECT symbol, open_time, {r(*OHLC)}, n_trades FROM bars")
def _(spark, sf):
    """Hourly bars per symbol from ticks."""
    return bars_1h(spark, sf)


@query("bars_1d", f"WITH {BARS_1D} SELECT symbol, open_time, {r(*OHLC, digits=4)}, n_trades FROM bars", digits=4)
def _(spark, sf):
    """Daily bars per order priority."""
    return bars_1d(spark, sf)


@query("resample_4h", f"""
WITH {BARS} SELECT symbol, time_bucket(INTERVAL 4 HOUR, open_time, TIMESTAMP '1970-01-01') AS open_time,
  {r("first(open ORDER BY open_time) AS open", "max(high) AS high", "min(low) AS low",
     "last(close ORDER BY open_time) AS close", "sum(volume) AS volume", "sum(quote_volume) AS quote_volume")},
  sum(n_trades)::BIGINT AS n_trades
FROM bars GROUP BY ALL""")
def _(spark, sf):
    """Bars from finer bars: open and close by time alone, hash aggregated."""
    return R.resample(bars_1h(spark, sf), "4h")


@query("resample_same_interval", f"WITH {BARS} SELECT symbol, open_time, {r(*OHLC)}, n_trades FROM bars")
def _(spark, sf):
    """Resampling to the bars' own interval changes nothing."""
    return R.resample(bars_1h(spark, sf), "1h")


@query("resample_custom_aggs", f"""
WITH {BARS} SELECT symbol, n_trades > 2 AS busy, date_trunc('day', open_time)::TIMESTAMP AS open_time,
  {r("max(high) AS high", "avg(close) AS close", "stddev_pop(volume) AS volume")}, count(open) AS open
FROM bars GROUP BY ALL""")
def _(spark, sf):
    """A column -> aggregate mapping, with a caller's function and an extra group key."""
    busy = bars_1h(spark, sf).withColumn("busy", F.col("n_trades") > 2)
    return R.resample(
        busy, "1d", keys=["symbol", "busy"],
        aggs={"high": "max", "close": "mean", "volume": F.stddev_pop, "open": "count"},
    )


MINUTE = TICKS + ", " + bars_sql("minute", "bars")
DONE = MINUTE + """, nw AS (SELECT max(ts) AS t FROM events),
newest AS (SELECT symbol, max(open_time) AS newest FROM bars GROUP BY 1),
done AS (SELECT b.* FROM bars b JOIN newest USING (symbol), nw
  WHERE NOT (open_time = newest AND (newest > t OR (date_trunc('minute', newest) = date_trunc('minute', t)
             AND second(t) < 45))))"""


def _now(spark, sf):
    """The table's own newest time, as a one-row column source."""
    return spark.read.parquet(f"{sf}/events.parquet").agg(F.max("ts").alias("as_of"))


def _as_of(spark, sf):
    """``as_of`` literal: a one-row aggregate of the whole table."""
    return F.lit(_now(spark, sf).first()["as_of"]).cast("timestamp_ntz")


def _minute_bars(spark, sf):
    return R.bars_from_ticks(ticks(spark, sf), "1m")


@query("drop_incomplete_tail", f"WITH {DONE} SELECT symbol, open_time, {r('close')} FROM done")
def _(spark, sf):
    """Minute bars without the newest bar of a symbol while its minute is open."""
    out = R.drop_incomplete(_minute_bars(spark, sf), _as_of(spark, sf))
    return out.select("symbol", "open_time", "close")


def _live_sql(minutes: int, shifted: bool = True) -> str:
    off = f"(minute(newest) + 1) % {minutes}" if shifted else "0"
    return f"""
WITH {DONE}, n2 AS (SELECT symbol, max(open_time) AS newest FROM done GROUP BY 1),
o AS (SELECT d.*, {off} AS off FROM done d JOIN n2 USING (symbol))
SELECT symbol, to_timestamp(0)::TIMESTAMP + to_minutes((floor((epoch(open_time) / 60 - off) / {minutes}) * {minutes} + off)::BIGINT) AS open_time,
  {r("first(open ORDER BY open_time) AS open", "max(high) AS high", "min(low) AS low",
     "last(close ORDER BY open_time) AS close", "sum(volume) AS volume", "sum(quote_volume) AS quote_volume")},
  sum(n_trades)::BIGINT AS n_trades
FROM o GROUP BY ALL"""


@query("resample_live_15m", _live_sql(15).replace("to_timestamp(0)::TIMESTAMP", "TIMESTAMP '1970-01-01'"))
def _(spark, sf):
    """Live alignment: the newest 15-minute bar ends at the newest row of its symbol."""
    return R.resample_live(_minute_bars(spark, sf), "15m", _as_of(spark, sf))


@query("resample_live_2h_clock", _live_sql(120, False).replace("to_timestamp(0)::TIMESTAMP", "TIMESTAMP '1970-01-01'"))
def _(spark, sf):
    """Default live rule: hour intervals stay aligned with the clock."""
    return R.resample_live(_minute_bars(spark, sf), "2h", _as_of(spark, sf))


@query("resample_live_2h_shifted", _live_sql(120).replace("to_timestamp(0)::TIMESTAMP", "TIMESTAMP '1970-01-01'"))
def _(spark, sf):
    """The other live rule: every interval is shifted."""
    return R.resample_live(_minute_bars(spark, sf), "2h", _as_of(spark, sf), all_intervals=True)


@query("signal_buckets_300s", """
SELECT user_id % 5 AS topic_id, event_type, floor(epoch(ts) / 300)::BIGINT AS bucket,
  round(first(value ORDER BY ts, event_id), 6) + 0.0 AS value, min(ts) AS ts
FROM events GROUP BY ALL""")
def _(spark, sf):
    """One value per key and five-minute bucket."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("topic_id", F.col("user_id") % 5)
    return R.first_per_bucket(e, ["topic_id", "event_type"], "ts", "value", ties=["event_id"])


GRID = BARS + """, span AS (SELECT symbol, min(open_time) AS lo, max(open_time) AS hi FROM bars GROUP BY 1),
grid AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS open_time FROM span),
full_grid AS (SELECT g.symbol, g.open_time, b.close FROM grid g LEFT JOIN bars b USING (symbol, open_time))"""


@query("densify_ffill", f"""
WITH {GRID} SELECT symbol, open_time, close IS NOT NULL AS observed,
  round(last_value(close IGNORE NULLS) OVER w, 6) + 0.0 AS close FROM full_grid {W}""")
def _(spark, sf):
    """Every grid hour, gaps filled with the last close."""
    return R.densify(bars_1h(spark, sf), "1h", how="ffill")


@query("densify_drop", f"""
WITH {GRID} SELECT symbol, open_time, close IS NOT NULL AS observed, {r('close')} FROM full_grid""")
def _(spark, sf):
    """Every grid hour, gaps left NULL."""
    return R.densify(bars_1h(spark, sf), "1h", how="drop")


@query("densify_linear", f"""
WITH {GRID}, n AS (SELECT *, last_value(close IGNORE NULLS) OVER p AS pv,
    last_value(CASE WHEN close IS NOT NULL THEN epoch(open_time) END IGNORE NULLS) OVER p AS pt,
    first_value(close IGNORE NULLS) OVER f AS nv,
    first_value(CASE WHEN close IS NOT NULL THEN epoch(open_time) END IGNORE NULLS) OVER f AS nt
  FROM full_grid WINDOW p AS (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING),
    f AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT symbol, open_time, close IS NOT NULL AS observed,
  round(coalesce(close, pv + (nv - pv) * (epoch(open_time) - pt) / (nt - pt)), 6) + 0.0 AS close FROM n""")
def _(spark, sf):
    """Every grid hour, gaps interpolated between their neighbours."""
    return R.densify(bars_1h(spark, sf), "1h", how="linear")


@query("snapshot_latest_closed", f"""
WITH {BARS}, nw AS (SELECT max(ts) AS t FROM events),
closed AS (SELECT bars.* FROM bars, nw WHERE open_time + INTERVAL 1 HOUR <= t),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM closed)
SELECT symbol, open_time, {r(*OHLC)}, n_trades FROM ranked WHERE k = 1""")
def _(spark, sf):
    """Newest closed hourly bar per symbol."""
    return R.snapshot(bars_1h(spark, sf), "1h", _as_of(spark, sf))


@query("latest_all_symbols", f"""
WITH {BARS} SELECT open_time, count(*) AS n_symbols, list_sort(list(symbol))::VARCHAR AS symbols FROM bars GROUP BY 1""")
def _(spark, sf):
    """Batch snapshot: the symbols that reported at each open time."""
    made = bars_1h(spark, sf).groupBy("open_time").agg(
        F.count(F.lit(1)).alias("n_symbols"), F.sort_array(F.collect_set("symbol")).alias("s")
    )
    return made.select("open_time", "n_symbols", F.concat(F.lit("["), F.array_join("s", ", "), F.lit("]")).alias("symbols"))


# ---------------------------------------------------------- window features
def windows_sql(n: int) -> str:
    """wf: one row per usable bar, lists of the last n scaled values."""
    one = ", ".join(f"list({c}) OVER w AS l_{c}" for c in ("open", "high", "low", "close", "volume"))
    return BARS + f""", wl AS (SELECT symbol, open_time, close, volume, {one} FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
wf AS (SELECT symbol, open_time, close,
    [x / close FOR x IN l_open] AS o, [x / close FOR x IN l_high] AS h, [x / close FOR x IN l_low] AS l,
    [x / close FOR x IN l_close] AS c, [x / volume FOR x IN l_volume] AS v
  FROM wl WHERE len(l_close) = {n} AND close <> 0 AND volume <> 0)"""


@query("window_features_long", f"""
WITH {windows_sql(12)}, i AS (SELECT unnest(range(12)) AS bar_idx),
x AS (SELECT symbol, open_time, bar_idx, unnest(['open', 'high', 'low', 'close', 'volume']) AS field,
  unnest([o[bar_idx + 1], h[bar_idx + 1], l[bar_idx + 1], c[bar_idx + 1], v[bar_idx + 1]]) AS value FROM wf, i)
SELECT symbol, open_time, bar_idx::INTEGER AS bar_idx, field, {r('value')} FROM x""")
def _(spark, sf):
    """The last 12 bars of every bar, scaled by its close and volume, in long form."""
    return X.long_form(X.window_features(bars_1h(spark, sf), 12, cell_s=MONTH))


def _wide_sql(n: int) -> str:
    items = [f"{f[0]}[{i + 1}] AS feature_{f}_{i}" for i in range(n) for f in ("open", "high", "low", "close", "volume")]
    return r(*items)


@query("window_features_wide", f"WITH {windows_sql(4)} SELECT symbol, open_time, {_wide_sql(4)} FROM wf")
def _(spark, sf):
    """Named feature columns, bar by bar."""
    rows = X.window_features(bars_1h(spark, sf), 4, cell_s=MONTH).where("window IS NOT NULL")
    return X.widen(rows.select("symbol", "open_time", "window"), 4)


TARGET = BARS + f""", tg AS (SELECT *, lead(close, 3) OVER w AS future_close FROM bars {W})"""


@query("log_return_target", f"""
WITH {TARGET} SELECT symbol, open_time, {r('close', 'future_close', 'ln(future_close) - ln(close) AS target')} FROM tg""")
def _(spark, sf):
    """Log return three bars ahead; NULL at the end of each history."""
    out = X.log_return_target(bars_1h(spark, sf), 3, cell_s=MONTH)
    return out.select("symbol", "open_time", "close", "future_close", "target")


TRAINING = windows_sql(12) + f""",
tg AS (SELECT symbol, open_time, lead(close) OVER w AS future_close FROM bars {W}),
train AS (SELECT b.symbol, b.open_time, b.open, b.high, b.low, b.close, b.volume, b.n_trades,
    f.c[1] AS first_close, f.c[12] AS last_close, f.v[1] AS first_volume,
    list_sum(f.h) AS high_total, f.c IS NOT NULL AS has_window, t.future_close, ln(t.future_close) - ln(b.close) AS target
  FROM bars b LEFT JOIN wf f USING (symbol, open_time) JOIN tg t USING (symbol, open_time))"""


@query("training_table", f"""
WITH {TRAINING} SELECT symbol, open_time, {r('open', 'high', 'low', 'close', 'volume', 'first_close', 'last_close',
'first_volume', 'high_total', 'future_close', 'target', digits=8)}, n_trades, has_window FROM train""", digits=8)
def _(spark, sf):
    """Ticks -> hourly bars -> window of 12 and one-bar target, all symbols in one plan."""
    out = X.training_table(bars_1h(spark, sf), "1h", 12, 1, cell_s=MONTH)
    win = F.col("window")
    return out.select(
        "symbol", "open_time", "open", "high", "low", "close", "volume", "n_trades",
        win[0]["close"].alias("first_close"), win[11]["close"].alias("last_close"),
        win[0]["volume"].alias("first_volume"),
        F.aggregate(X.field("high"), F.lit(0.0), lambda a, x: a + x).alias("high_total"),
        win.isNotNull().alias("has_window"), "future_close", "target",
    )


@query("complete_rows", f"""
WITH {TRAINING} SELECT symbol, open_time, {r('last_close', 'target')} FROM train WHERE has_window AND target IS NOT NULL""")
def _(spark, sf):
    """Training rows whose features and target are all known."""
    done = X.complete_rows(X.training_table(bars_1h(spark, sf), "1h", 12, 1, cell_s=MONTH))
    return done.select("symbol", "open_time", F.col("window")[11]["close"].alias("last_close"), "target")


@query("join_features_to_bars", f"""
WITH {windows_sql(12)} SELECT b.symbol, b.open_time, {r('b.close AS close', 'list_sum(f.c) AS close_total')}
FROM bars b LEFT JOIN wf f USING (symbol, open_time)""")
def _(spark, sf):
    """Bars left-joined with their features on symbol and time."""
    bars = bars_1h(spark, sf)
    feats = X.window_features(bars, 12, cell_s=MONTH).where("window IS NOT NULL")
    feats = feats.select("symbol", "open_time", F.aggregate(X.field("close"), F.lit(0.0), lambda a, x: a + x).alias("close_total"))
    return bars.select("symbol", "open_time", "close").join(feats, ["symbol", "open_time"], "left")


@query("model_input_columns", f"WITH {windows_sql(4)} SELECT {_wide_sql(4)} FROM wf")
def _(spark, sf):
    """Feature columns only; raw and future columns are refused."""
    rows = X.window_features(bars_1h(spark, sf), 4, cell_s=MONTH).where("window IS NOT NULL")
    return X.model_inputs(X.widen(rows, 4), X.feature_names(4))


@query("features_at_times", f"""
WITH {windows_sql(12)}, a AS (SELECT symbol, ts AS "at" FROM ticks)
SELECT a.symbol, a."at", wf.open_time AS matched_time, {r('wf.c[1] AS first_close')}
FROM a ASOF LEFT JOIN wf ON a.symbol = wf.symbol AND a."at" >= wf.open_time""")
def _(spark, sf):
    """Features as known at arbitrary request times."""
    feats = X.window_features(bars_1h(spark, sf), 12, cell_s=MONTH).where("window IS NOT NULL")
    feats = feats.select("symbol", "open_time", F.col("window")[0]["close"].alias("first_close"))
    times = ticks(spark, sf).select("symbol", F.col("ts").alias("at"))
    return X.features_at(feats, times, cell_s=TICK_CELL)


LIVE = DONE.replace("nw AS (", "nw AS (") + """,
recent AS (SELECT done.* FROM done, nw WHERE open_time > t - INTERVAL 14 HOUR),
hb AS (SELECT symbol, date_trunc('hour', open_time)::TIMESTAMP AS open_time, last(close ORDER BY open_time) AS close,
   sum(volume) AS volume FROM recent GROUP BY 1, 2),
hl AS (SELECT symbol, open_time, close, volume, list(close) OVER w AS cl, row_number() OVER d AS k,
   count(*) OVER (PARTITION BY symbol) AS n_bars FROM hb
   WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
          d AS (PARTITION BY symbol ORDER BY open_time DESC))"""


@query("live_features", f"""
WITH {LIVE} SELECT symbol, open_time, {r('close AS current_price')}, n_bars, n_bars >= 12 AS enough,
  CASE WHEN n_bars >= 12 AND close <> 0 AND volume <> 0 THEN round(cl[1] / close, 6) + 0.0 END AS first_close
FROM hl WHERE k = 1""")
def _(spark, sf):
    """The newest window and current price per symbol, over a bounded look-back."""
    out = X.live_features(_minute_bars(spark, sf), "1h", 12, _as_of(spark, sf), cell_s=MONTH)
    return out.select("symbol", "open_time", "current_price", "n_bars", "enough", F.col("window")[0]["close"].alias("first_close"))


# ------------------------------------------------------ engineered features
@query("log_return_features", f"""
WITH {windows_sql(26)} SELECT symbol, open_time, {r(*[f"ln(c[26] + 1e-8) - ln(c[{27 - k}] + 1e-8) AS {n}"
 for n, k in X.RETURN_LAGS.items()])} FROM wf""")
def _(spark, sf):
    """Log returns over 1, 6, 12 and 24 bars of the scaled closes."""
    rows = X.window_features(bars_1h(spark, sf), 26, cell_s=MONTH).where("window IS NOT NULL")
    return X.with_columns(rows.select("symbol", "open_time", "window"), X.log_returns(26)).drop("window")


def ema_sql(src: str, n: int, period: int) -> str:
    """List of EMA values after each element of list ``src``."""
    a = 2.0 / (period + 1)
    seed = f"list_avg({src}[1:{min(period, n)}])"
    return (
        f"list_transform(range(1, {n} + 1), lambda i: CASE WHEN i = 1 THEN {seed} ELSE "
        f"list_reduce({src}[2:i], lambda acc, y: acc * (1 - {a!r}) + y * {a!r}, {seed}) END)"
    )


def _macd_sql(n: int) -> str:
    return (
        f"m1 AS (SELECT *, {ema_sql('c', n, 12)} AS e12, {ema_sql('c', n, 26)} AS e26 FROM wf), "
        f"m2 AS (SELECT *, list_transform(range(1, {n} + 1), lambda j: e12[j] - e26[j]) AS m FROM m1), "
        f"m3 AS (SELECT *, {ema_sql('m', n, 9)} AS sg FROM m2)"
    )


def _technical_sql(n: int) -> list[str]:
    hl = f"list_transform(range(1, {n} + 1), lambda q: h[q] - l[q])"
    steps = f"list_transform(range({n - 4}, {n} + 1), lambda q: c[q] - c[q - 1])"
    return [
        *[f"list_avg(c[{n - k + 1}:{n}]) AS sma_{k}" for k in (5, 10, 20)],
        f"c[{n}] - c[{n - 1}] AS return_1h", f"c[{n}] - c[{n - 6}] AS return_6h", f"c[{n}] - c[{n - 12}] AS return_12h",
        f"list_stddev_pop({steps}) AS volatility_5h",
        f"list_avg({hl}) AS hl_spread_mean", f"list_avg(({hl})[{n - 4}:{n}]) AS hl_spread_recent",
        "list_avg(v) AS volume_mean", f"list_avg(v[{n - 4}:{n}]) AS volume_recent",
        f"c[{n}] - list_avg(c[{n - 19}:{n}]) AS price_distance_from_sma20",
    ]


@query("technical_features", f"""
WITH {windows_sql(26)}, {_macd_sql(26)} SELECT symbol, open_time,
{r(*_technical_sql(26), 'm[26] AS macd', 'sg[26] AS macd_signal', 'm[26] - sg[26] AS macd_histogram', digits=10)} FROM m3""", digits=10)
def _(spark, sf):
    """Averages, returns, volatility, spreads, volume and MACD of a 26-bar window."""
    rows = X.window_features(bars_1h(spark, sf), 26, cell_s=MONTH).where("window IS NOT NULL")
    return X.with_technical(rows.select("symbol", "open_time", "window"), 26).drop("window")


@query("macd_short_window", f"""
WITH {windows_sql(14)}, m1 AS (SELECT *, {ema_sql('c', 14, 12)} AS e12 FROM wf)
SELECT symbol, open_time, {r('e12[14] - c[1] AS macd', '0.0::DOUBLE AS macd_signal', 'e12[14] - c[1] AS macd_histogram')} FROM m1""")
def _(spark, sf):
    """The fallback for windows between the fast and the slow period."""
    rows = X.window_features(bars_1h(spark, sf), 14, cell_s=MONTH).where("window IS NOT NULL")
    out = X.with_technical(rows.select("symbol", "open_time", "window"), 14)
    return out.select("symbol", "open_time", "macd", "macd_signal", "macd_histogram")


@query("ema_features", f"""
WITH {windows_sql(12)} SELECT symbol, open_time, {r(*[f"({ema_sql('c', 12, p)})[12] AS ema_{p}" for p in (3, 5, 9, 20)])} FROM wf""")
def _(spark, sf):
    """EMAs of the window; one period is longer than the window."""
    from candlespark.functions import arrays

    rows = X.window_features(bars_1h(spark, sf), 12, cell_s=MONTH).where("window IS NOT NULL")
    made = {f"ema_{p}": arrays.ema(X.field("close"), 12, p) for p in (3, 5, 9, 20)}
    return X.with_columns(rows.select("symbol", "open_time", "window"), made).drop("window")


@query("chart_series", f"""
WITH {BARS}, wf AS (SELECT *, list(close) OVER {last(30)} AS c0 FROM bars),
w2 AS (SELECT * REPLACE (CASE WHEN len(c0) = 30 THEN c0 END AS c0), CASE WHEN len(c0) = 30 THEN c0 END AS c FROM wf),
m1 AS (SELECT *, {ema_sql('c', 30, 12)} AS e12, {ema_sql('c', 30, 26)} AS e26 FROM w2 WHERE c IS NOT NULL),
m2 AS (SELECT *, list_transform(range(1, 31), lambda j: e12[j] - e26[j]) AS m FROM m1),
m3 AS (SELECT *, {ema_sql('m', 30, 9)} AS sg FROM m2),
s AS (SELECT symbol, open_time, avg(close) OVER {last(5)} AS sma_5, avg(close) OVER {last(10)} AS sma_10,
   avg(close) OVER {last(20)} AS sma_20 FROM bars)
SELECT symbol, open_time, {r('sma_5', 'sma_10', 'sma_20', 'm[30] AS macd', 'sg[30] AS macd_signal', 'm[30] - sg[30] AS macd_histogram')}
FROM s LEFT JOIN m3 USING (symbol, open_time)""")
def _(spark, sf):
    """Moving averages (partial at the left edge) and MACD along the bars."""
    out = X.rolling(bars_1h(spark, sf), 30, lambda d, w: X.chart_series(d, w, 30), cell_s=MONTH)
    return out.select("symbol", "open_time", "sma_5", "sma_10", "sma_20", "macd", "macd_signal", "macd_histogram")


STEPS = BARS + f""", st AS (SELECT *, ln(close) - ln(lag(close) OVER w) AS r,
  row_number() OVER w AS rn FROM bars {W})"""


def _horizon_sql(h: int) -> str:
    out = []
    for k in X.horizon_windows(h):
        for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("sum", "sum")):
            out.append(f"CASE WHEN rn > {k} THEN {fn}(r) OVER {last(k)} END AS ret_{name}_{k}")
    return r(*out)


@query("horizon_features", f"WITH {STEPS} SELECT symbol, open_time, {_horizon_sql(12)} FROM st")
def _(spark, sf):
    """Look-backs from a quarter to ten times the 12-bar horizon, one shared sort."""
    reach = max(X.horizon_windows(12)) + 1
    out = X.rolling(bars_1h(spark, sf).select("symbol", "open_time", "close"), reach, lambda d, w: X.horizon_features(d, w, 12), cell_s=MONTH)
    return out.drop("close")


@query("rolling_trend", f"""
WITH {STEPS}, t AS (SELECT *, ln(close) - ln(lag(close, 24) OVER w) AS move,
  CASE WHEN rn > 24 THEN stddev_samp(r) OVER {last(24)} END AS vol FROM st {W})
SELECT symbol, open_time, round(CASE WHEN vol <> 0 THEN move / vol END, 6) + 0.0 AS trend FROM t""")
def _(spark, sf):
    """Return over volatility at the same scale."""
    out = X.rolling(bars_1h(spark, sf), 25, lambda d, w: X.trend(d, w, 24), cell_s=MONTH)
    return out.select("symbol", "open_time", "trend")


@query("zscore_reversion", f"""
WITH {STEPS}, z AS (SELECT *, avg(close) OVER f AS m, stddev_samp(close) OVER f AS s FROM st WINDOW f AS {last(24)})
SELECT symbol, open_time, round(CASE WHEN rn >= 24 AND s <> 0 THEN (close - m) / s END, 6) + 0.0 AS zscore FROM z""")
def _(spark, sf):
    """Distance from the trailing mean in trailing deviations."""
    out = X.rolling(bars_1h(spark, sf), 23, lambda d, w: X.zscore(d, w, 24), cell_s=MONTH)
    return out.select("symbol", "open_time", "zscore")


@query("trailing_percentile_rank", f"""
WITH {BARS}, p AS (SELECT *, list(close) OVER {last(24)} AS c FROM bars)
SELECT symbol, open_time, round(CASE WHEN len(c) = 24 THEN len(list_filter(c, lambda x: x <= close)) / 24.0 END, 6) + 0.0 AS pct_rank FROM p""")
def _(spark, sf):
    """Share of the last 24 closes at or below the newest."""
    out = X.rolling(bars_1h(spark, sf), 23, lambda d, w: X.percentile_rank(d, w, 24), cell_s=MONTH)
    return out.select("symbol", "open_time", "pct_rank")


@query("trailing_rank_long", f"""
WITH {TICKS}, p AS (SELECT *, list(price) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS c FROM ticks)
SELECT symbol, seq, round(CASE WHEN len(c) = 1000 THEN len(list_filter(c, lambda x: x <= price)) / 1000.0 END, 6) + 0.0 AS pct_rank FROM p""")
def _(spark, sf):
    """Share of the last 1,000 prices at or below the newest, from sorted runs."""
    t = ticks(spark, sf).select("symbol", "ts", "price", "seq")
    return X.trailing_rank(t, 1_000, "price", time="ts", ties=["seq"]).select("symbol", "seq", "pct_rank")


@query("realised_variance", f"""
WITH {BARS}, st AS (SELECT *, row_number() OVER w AS rn, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close) - ln(lag(close) OVER w) END AS r,
  CASE WHEN low <> 0 AND high / low > 0 THEN ln(high / low) END AS g FROM bars {W})
SELECT symbol, open_time,
{r(f"CASE WHEN rn > 24 THEN sum(r * r) OVER {last(24)} END AS realised_var",
   f"CASE WHEN rn >= 24 THEN avg(g) OVER {last(24)} END AS range_vol")} FROM st""")
def _(spark, sf):
    """Sum of squared steps and mean log range over 24 bars; a step or range at a price of 0 is undefined, NULL, and adds nothing."""
    out = X.rolling(bars_1h(spark, sf), 25, lambda d, w: X.variance_features(d, w, 24), cell_s=MONTH)
    return out.select("symbol", "open_time", "realised_var", "range_vol")


@query("momentum_features", f"""
WITH {BARS}, a AS (SELECT *, avg(close) OVER {last(10)} AS ma FROM bars),
b AS (SELECT *, list(ma) OVER {last(10)} AS mas, list(close) OVER {last(26)} AS c, lag(close, 10) OVER w AS old,
  row_number() OVER w AS rn FROM a {W}),
s AS (SELECT b.symbol, b.open_time, regr_slope(y, x) AS ma_slope FROM b,
   unnest(range(1, 11)) u(x0), LATERAL (SELECT mas[x0] AS y, x0 AS x) q WHERE len(mas) = 10 GROUP BY 1, 2)
SELECT b.symbol, b.open_time, {r('s.ma_slope AS ma_slope', 'close / old - 1 AS rate_of_change',
 f"CASE WHEN rn >= 26 THEN ({ema_sql('c', 26, 12)})[26] / ({ema_sql('c', 26, 26)})[26] END AS ema_ratio")}
FROM b LEFT JOIN s USING (symbol, open_time)""")
def _(spark, sf):
    """Slope of the trailing mean, rate of change, ratio of EMAs."""
    out = X.rolling(bars_1h(spark, sf), 25, lambda d, w: X.momentum_features(d, w, 10), cell_s=MONTH)
    return out.select("symbol", "open_time", "ma_slope", "rate_of_change", "ema_ratio")


@query("activity_features", f"""
WITH {BARS}, a AS (SELECT *, row_number() OVER w AS rn FROM bars {W})
SELECT symbol, open_time, {r(
 f"CASE WHEN rn >= 24 AND avg(volume) OVER {last(24)} <> 0 THEN volume / avg(volume) OVER {last(24)} END AS volume_ratio",
 f"CASE WHEN rn >= 24 THEN n_trades / avg(n_trades) OVER {last(24)} END AS trades_ratio",
 "volume / n_trades AS trade_size",
 f"CASE WHEN rn >= 24 AND sum(volume) OVER {last(24)} <> 0 THEN sum(sign(close - open) * volume) OVER {last(24)} / sum(volume) OVER {last(24)} END AS imbalance")}
FROM a""")
def _(spark, sf):
    """Volume, trade-count and direction imbalance ratios."""
    out = X.rolling(bars_1h(spark, sf), 23, lambda d, w: X.activity_features(d, w, 24), cell_s=MONTH)
    return out.select("symbol", "open_time", "volume_ratio", "trades_ratio", "trade_size", "imbalance")


def _pair_sql(k: int) -> str:
    f = f"(ORDER BY open_time ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"""{BARS}, ab AS (SELECT open_time, a.close AS ca, b.close AS cb FROM bars a JOIN bars b USING (open_time)
  WHERE a.symbol = 'click' AND b.symbol = 'view'),
s AS (SELECT *, ln(ca) - ln(lag(ca) OVER (ORDER BY open_time)) AS x, ln(cb) - ln(lag(cb) OVER (ORDER BY open_time)) AS y,
  row_number() OVER (ORDER BY open_time) AS rn FROM ab),
c AS (SELECT *, CASE WHEN rn > {k} THEN (avg(x * y) OVER f - avg(x) OVER f * avg(y) OVER f)
   / (stddev_pop(x) OVER f * stddev_pop(y) OVER f) END AS rc FROM s WINDOW f AS {f})"""


@query("cross_asset_features", f"""
WITH {_pair_sql(24)} SELECT open_time, {r('ca AS close_a', 'cb AS close_b', 'x - y AS step_spread', 'rc AS rolling_corr',
'rc - lag(rc, 24) OVER (ORDER BY open_time) AS corr_change')} FROM c""")
def _(spark, sf):
    """Step spread and rolling correlation of two aligned symbols."""
    bars = bars_1h(spark, sf)
    return X.cross_asset(bars.where("symbol = 'click'"), bars.where("symbol = 'view'"), 24, cell_s=MONTH)


def _each_sql(k: int) -> str:
    """The pair twin, with every symbol against one."""
    text = _pair_sql(k).replace("SELECT open_time, a.close", "SELECT a.symbol, open_time, a.close").replace("a.symbol = 'click'", "a.symbol <> 'view'")
    return text.replace("(ORDER BY open_time", "(PARTITION BY symbol ORDER BY open_time")


@query("cross_asset_each", f"""
WITH {_each_sql(24)} SELECT symbol, open_time, {r('ca AS close_a', 'cb AS close_b', 'x - y AS step_spread', 'rc AS rolling_corr',
'rc - lag(rc, 24) OVER (PARTITION BY symbol ORDER BY open_time) AS corr_change')} FROM c""")
def _(spark, sf):
    """Step spread and rolling correlation of every symbol with a benchmark symbol."""
    bars = bars_1h(spark, sf)
    return X.cross_asset(bars.where("symbol <> 'view'"), bars.where("symbol = 'view'"), 24, cell_s=MONTH, keys=["symbol"])


@query("training_table_range", f"""
WITH {TRAINING} SELECT symbol, open_time, {r('last_close', 'target', digits=8)}, has_window FROM train
WHERE open_time >= TIMESTAMP '2024-01-10' AND open_time <= TIMESTAMP '2024-01-20'""", digits=8)
def _(spark, sf):
    """Training rows of a range; windows reach back beyond its start and targets beyond its end."""
    out = X.training_table(bars_1h(spark, sf), "1h", 12, 1, cell_s=MONTH, start="2024-01-10", end="2024-01-20")
    return out.select("symbol", "open_time", F.col("window")[11]["close"].alias("last_close"), "target", F.col("window").isNotNull().alias("has_window"))


@query("registered_features", f"""
WITH {BARS} SELECT symbol, open_time, {r('(high + low) / 2 AS mid', '(close - (high + low) / 2) / ((high + low) / 2) AS off_mid')} FROM bars""")
def _(spark, sf):
    """Features that a user registers by name, one built on the other."""
    X.register_feature("mid", lambda d: d.withColumn("mid", (F.col("high") + F.col("low")) / 2))
    X.register_feature("off_mid", lambda d: d.withColumn("off_mid", (F.col("close") - F.col("mid")) / F.col("mid")))
    return X.apply_features(bars_1h(spark, sf), ["mid", "off_mid"]).select("symbol", "open_time", "mid", "off_mid")


@query("target_family", f"""
WITH {STEPS}, t AS (SELECT *, ln(lead(close, 6) OVER w) - ln(close) AS tr, count(*) OVER f AS nf, sum(r * r) OVER f AS ss FROM st
 WINDOW w AS (PARTITION BY symbol ORDER BY open_time),
        f AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING))
SELECT symbol, open_time, {r('tr AS target_return', 'CASE WHEN nf = 6 THEN sqrt(ss) END AS target_vol')},
 sign(tr)::INTEGER AS target_direction, CASE WHEN r IS NOT NULL AND tr IS NOT NULL THEN sign(tr) * sign(r) < 0 END AS target_flip FROM t""")
def _(spark, sf):
    """Forward return, volatility, direction and sign change."""
    out = X.rolling(bars_1h(spark, sf), 1, lambda d, w: X.target_family(d, w, 6), after=6, cell_s=MONTH)
    return out.select("symbol", "open_time", "target_return", "target_vol", "target_direction", "target_flip")


@query("excess_target", f"""
WITH {BARS}, t AS (SELECT symbol, open_time, ln(lead(close, 3) OVER w) - ln(close) AS target FROM bars {W})
SELECT a.symbol, a.open_time, {r('a.target AS target', 'b.target AS benchmark_target', 'a.target - b.target AS excess')}
FROM t a JOIN t b ON a.open_time = b.open_time AND b.symbol = 'view' WHERE a.symbol <> 'view'""")
def _(spark, sf):
    """Target in excess of a benchmark symbol's target."""
    bars = bars_1h(spark, sf)
    base = bars.where("symbol = 'view'").select("open_time", "close")
    return X.excess_target(bars.where("symbol <> 'view'").select("symbol", "open_time", "close"), base, 3, cell_s=MONTH)


@query("train_only_scaling", f"""
WITH {BARS}, s AS (SELECT symbol, avg(close) AS m, stddev_samp(close) AS sd FROM bars
  WHERE open_time < TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT symbol, open_time, {r('(close - m) / sd AS close_scaled')} FROM bars JOIN s USING (symbol)""")
def _(spark, sf):
    """Scaling fitted on the optimisation part only, applied to all rows."""
    bars = bars_1h(spark, sf)
    fitted = X.fit_scaler(bars.where("open_time < TIMESTAMP_NTZ '2024-01-20 00:00:00'"), ["close"])
    return X.apply_scaler(bars, fitted, ["close"]).select("symbol", "open_time", "close_scaled")


@query("asof_external", f"""
WITH {BARS}, dq AS (SELECT symbol, ts, arg_max(price, seq) AS price FROM ticks GROUP BY 1, 2)
SELECT b.symbol, b.open_time, dq.ts AS matched_time, {r('b.close AS close', 'dq.price AS price')}
FROM bars b ASOF LEFT JOIN dq ON b.symbol = dq.symbol AND b.open_time - INTERVAL 900 SECOND >= dq.ts""")
def _(spark, sf):
    """Newest external row published at least 15 minutes before each bar."""
    bars = bars_1h(spark, sf).select("symbol", "open_time", "close")
    return asof_join(bars, ticks(spark, sf), ["symbol"], "open_time", "ts", ["price"], lag_s=900, ties=["seq"], cell_s=TICK_CELL)


@query("asof_tolerance", f"""
WITH {BARS}, q AS (SELECT symbol, ts, arg_max(price, seq) AS price FROM ticks GROUP BY 1, 2),
j AS (SELECT b.symbol, b.open_time, q.ts, q.price FROM bars b ASOF LEFT JOIN q ON b.symbol = q.symbol AND b.open_time >= q.ts)
SELECT symbol, open_time, CASE WHEN epoch_us(open_time) - epoch_us(ts) <= 600000000 THEN ts END AS matched_time,
 round(CASE WHEN epoch_us(open_time) - epoch_us(ts) <= 600000000 THEN price END, 6) + 0.0 AS price FROM j""")
def _(spark, sf):
    """As-of join that drops matches older than ten minutes."""
    bars = bars_1h(spark, sf).select("symbol", "open_time")
    return asof_join(bars, ticks(spark, sf), ["symbol"], "open_time", "ts", ["price"], tolerance_s=600, ties=["seq"], cell_s=TICK_CELL)


@query("lookahead_audit", f"""
WITH {BARS}, f AS (SELECT *, ln(close) - ln(lag(close) OVER w) AS past_step, ln(lead(close) OVER w) - ln(close) AS leak,
   ln(lead(close) OVER w) - ln(close) AS target FROM bars {W}),
s AS (SELECT symbol, past_step, leak, unnest([-2, 0, 2, 50]) AS shift,
   unnest([lag(target, 2) OVER w, target, lead(target, 2) OVER w, lead(target, 50) OVER w]) AS y FROM f {W}),
u AS (SELECT symbol, shift, y, unnest(['past_step', 'leak']) AS feature, unnest([past_step, leak]) AS x FROM s)
SELECT symbol, feature, shift::INTEGER AS shift, round(corr(x, y), 6) + 0.0 AS corr, count(*) AS n
FROM u WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    """Correlation of features with the target at possible and impossible shifts."""

    def columns(d, w):
        d = d.withColumn("past_step", X.log_step(w))
        return d.withColumn("leak", ln(F.lead("close").over(w)) - ln("close")).withColumn("target", F.col("leak"))

    rows = X.rolling(bars_1h(spark, sf).select("symbol", "open_time", "close"), 1, columns, after=1, cell_s=MONTH)
    return X.shift_correlations(rows, ["past_step", "leak"], "target", [-2, 0, 2, 50], cell_s=MONTH)


@query("truncation_audit", f"""
WITH {STEPS}, z AS (SELECT symbol, open_time, CASE WHEN rn >= 24 THEN avg(close) OVER {last(24)} END AS m FROM st),
c AS (SELECT symbol, open_time, close, row_number() OVER w AS rn FROM bars WHERE open_time < TIMESTAMP '2024-01-21' {W}),
y AS (SELECT symbol, open_time, CASE WHEN rn >= 24 THEN avg(close) OVER {last(24)} END AS m FROM c)
SELECT y.symbol, count(*) AS n_rows, count(*) FILTER (WHERE round(y.m, 9) IS DISTINCT FROM round(z.m, 9)) AS n_changed
FROM y LEFT JOIN z USING (symbol, open_time) GROUP BY 1""")
def _(spark, sf):
    """Features of a history cut off early equal those of the full history."""
    bars = bars_1h(spark, sf).select("symbol", "open_time", "close")

    def mean24(d, w):
        return d.withColumn("m", F.round(X.full_window(w, 24, F.avg("close").over(X.last_rows(w, 24))), 9))

    full = X.rolling(bars, 23, mean24, cell_s=MONTH)
    short = X.rolling(bars.where("open_time < TIMESTAMP_NTZ '2024-01-21 00:00:00'"), 23, mean24, cell_s=MONTH)
    changed = X.truncation_diff(full, short, ["symbol"], ["m"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_changed"))
    total = short.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))
    return total.join(changed, "symbol", "left").select("symbol", "n_rows", F.coalesce("n_changed", F.lit(0)).alias("n_changed"))


@query("point_in_time_universe", f"""
WITH {BARS_1D} SELECT symbol, open_time, row_number() OVER w AS bars_so_far,
 min(open_time) OVER (PARTITION BY symbol) AS first_time, row_number() OVER w >= 100 AS eligible FROM bars {W}""")
def _(spark, sf):
    """Symbols eligible as of each day: at least 100 bars seen so far."""
    return X.universe(bars_1d(spark, sf), 100, cell_s=YEAR)
