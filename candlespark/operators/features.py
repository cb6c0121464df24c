"""Sliding-window features and forward targets.

All windows count rows of the bar table and look back only; they run over row
blocks (:mod:`candlespark.operators.blocks`), so one symbol with a long
history is spread over many tasks.  Chained windows share one block layout.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from candlespark.functions import arrays
from candlespark.functions.safe import div, ln
from candlespark.operators.asof import asof_join
from candlespark.operators.blocks import DAY, HOUR, over_blocks
from candlespark.operators.resample import drop_incomplete, resample, resample_live
from candlespark.schema import BAR_FIELDS
from candlespark.sources.bars import time_range

KEYS = ("symbol",)


# ------------------------------------------------------------ base features
def window_columns(rows: DataFrame, w: WindowSpec, n: int) -> DataFrame:
    """Add ``window``: the last ``n`` bars, oldest first, scaled by the newest.

    Prices are divided by the newest close and volumes by the newest volume.
    NULL with fewer than ``n`` bars, or when the newest close or volume is 0
    or not a number.
    """
    last_n = w.rowsBetween(-(n - 1), 0)
    bar = F.struct(*[F.col(c) for c in BAR_FIELDS])
    full = F.collect_list(bar).over(last_n)
    close, volume = F.col("close"), F.col("volume")
    usable = (close != 0) & (volume != 0) & ~F.isnan(close) & ~F.isnan(volume)

    def scaled(b: Column) -> Column:
        prices = [(b[c] / F.col("close")).alias(c) for c in BAR_FIELDS[:4]]
        return F.struct(*prices, (b["volume"] / F.col("volume")).alias("volume"))

    return rows.withColumn("_bars", full).withColumn(
        "window", F.when((F.size("_bars") == n) & usable, F.transform("_bars", scaled))
    ).drop("_bars")


def target_columns(rows: DataFrame, w: WindowSpec, h: int) -> DataFrame:
    """Add ``future_close`` (close ``h`` bars ahead) and the log-return ``target``."""
    return rows.withColumn("future_close", F.lead("close", h).over(w)).withColumn(
        "target", ln("future_close") - ln("close")
    )


def window_features(bars: DataFrame, n: int, keys: Sequence[str] = KEYS, cell_s: int = DAY) -> DataFrame:
    return over_blocks(bars, keys, "open_time", n - 1, 0, lambda d, w: window_columns(d, w, n), cell_s=cell_s)


def log_return_target(bars: DataFrame, h: int, keys: Sequence[str] = KEYS, cell_s: int = DAY) -> DataFrame:
    return over_blocks(bars, keys, "open_time", 0, h, lambda d, w: target_columns(d, w, h), cell_s=cell_s)


def feature_names(n: int) -> list[str]:
    return [f"feature_{f}_{i}" for i in range(n) for f in BAR_FIELDS]


def widen(rows: DataFrame, n: int) -> DataFrame:
    """``window`` -> columns ``feature_<field>_<i>``, bar by bar, 0 = oldest."""
    wide = [F.col("window")[i][f].alias(f"feature_{f}_{i}") for i in range(n) for f in BAR_FIELDS]
    return rows.select(*[c for c in rows.columns if c != "window"], *wide)


def long_form(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``window`` -> rows (keys, open_time, bar_idx, field, value)."""
    bars = rows.where(F.col("window").isNotNull()).select(*keys, "open_time", F.posexplode("window").alias("bar_idx", "b"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").alias("value")) for f in BAR_FIELDS])
    return bars.select(*keys, "open_time", "bar_idx", F.explode(pairs).alias("p")).select(
        *keys, "open_time", "bar_idx", "p.field", "p.value"
    )


def training_table(
    bars: DataFrame, freq: str, n: int, h: int, keys: Sequence[str] = KEYS, cell_s: int = DAY, start=None, end=None
) -> DataFrame:
    """Resampled bars with window features and target: one block pass for all symbols.

    ``start`` and ``end`` bound the rows returned; their windows and targets
    reach beyond.
    """

    def columns(d, w):
        return target_columns(window_columns(d, w, n), w, h)

    fine = resample(bars, freq, keys)
    return time_range(over_blocks(fine, keys, "open_time", n - 1, h, columns, cell_s=cell_s), start, end)


def complete_rows(rows: DataFrame, columns: Sequence[str] = ("window", "target")) -> DataFrame:
    return rows.dropna(subset=list(columns))


def model_inputs(rows: DataFrame, names: Sequence[str], target: str | None = None) -> DataFrame:
    """Only registered feature columns reach the model; raw and future columns are refused."""
    raw = {*BAR_FIELDS, "quote_volume", "n_trades", "future_close", "target"}
    wrong = sorted(raw & set(names))
    if wrong:
        raise ValueError(f"not features: {wrong}")
    return rows.select(*names, *([target] if target else []))


def features_at(
    features: DataFrame, times: DataFrame, keys: Sequence[str] = KEYS, time: str = "at", cell_s: int = HOUR
) -> DataFrame:
    """Features as known at arbitrary request times: the newest row at or before each."""
    value = [c for c in features.columns if c not in (*keys, "open_time")]
    return asof_join(times, features, keys, time, "open_time", value, cell_s=cell_s)


def look_back_hours(freq: str, n: int) -> int:
    """Hours of history that hold ``n`` bars of ``freq``, with room for alignment."""
    from candlespark.functions.times import interval_minutes

    return -(-n * interval_minutes(freq) // 60) + 2


def live_features(
    bars: DataFrame, freq: str, n: int, as_of: Column, keys: Sequence[str] = KEYS,
    all_intervals: bool = False, cell_s: int = DAY,
) -> DataFrame:
    """One row per key: the newest window and ``current_price``.

    Runs the training code over a bounded look-back.  Keys with fewer than
    ``n`` bars come out with ``enough = false`` and no window.
    """
    # The bare column against a literal, so that the bound reaches the scan.
    recent = bars.where(F.col("open_time") > as_of - F.expr(f"INTERVAL {look_back_hours(freq, n)} HOURS"))
    fine = resample_live(recent, freq, as_of, keys, all_intervals=all_intervals)
    newest = window_features(fine, n, keys, cell_s).groupBy(*keys).agg(
        F.max_by(F.struct("open_time", "close", "window"), "open_time").alias("_row"),
        F.count(F.lit(1)).alias("n_bars"),
    )
    return newest.select(
        *keys, "_row.open_time", F.col("_row.close").alias("current_price"), "n_bars",
        (F.col("n_bars") >= n).alias("enough"), "_row.window",
    )


# ------------------------------------------------------ engineered features
# Look-backs (bars from the end) of the log-return features.
RETURN_LAGS = {"log_return_1h": 2, "log_return_6h": 7, "log_return_12h": 13, "log_return_24h": 25}
EPSILON = 1e-8


def field(name: str) -> Column:
    return F.transform("window", lambda b: b[name])


def log_returns(n: int, lags: Mapping[str, int] = RETURN_LAGS) -> dict[str, Column]:
    closes = field("close")

    def one(k: int) -> Column:
        if n < k:
            return F.lit(0.0)
        return F.ln(arrays.back(closes, 1) + EPSILON) - F.ln(arrays.back(closes, k) + EPSILON)

    return {name: one(k) for name, k in lags.items()}


def technical(n: int) -> dict[str, Column]:
    """Moving averages, returns, spreads, volume and MACD of one window."""
    close, volume = F.col("_close"), F.col("_volume")
    spread = F.col("_spread")
    line, signal = arrays.macd(close, n)

    def change(k: int) -> Column:
        return arrays.back(close, 1) - arrays.back(close, k) if n >= k else F.lit(0.0)

    out = {f"sma_{k}": arrays.tail_mean(close, n, k) for k in (5, 10, 20)}
    out |= {"return_1h": change(2), "return_6h": change(7), "return_12h": change(13)}
    out["volatility_5h"] = arrays.diff_std(close, n)
    out["hl_spread_mean"] = arrays.tail_mean(spread, n, n)
    out["hl_spread_recent"] = arrays.tail_mean(spread, n, 5)
    out["volume_mean"] = arrays.tail_mean(volume, n, n)
    out["volume_recent"] = arrays.tail_mean(volume, n, 5)
    out["price_distance_from_sma20"] = arrays.back(close, 1) - arrays.tail_mean(close, n, 20)
    out |= {"macd": line, "macd_signal": signal, "macd_histogram": line - signal}
    return out


def with_technical(rows: DataFrame, n: int) -> DataFrame:
    inputs = rows.select(
        "*",
        field("close").alias("_close"),
        field("volume").alias("_volume"),
        F.transform("window", lambda b: b["high"] - b["low"]).alias("_spread"),
    )
    made = [F.when(F.col("window").isNotNull(), c).alias(k) for k, c in technical(n).items()]
    return inputs.select(*rows.columns, *made)


def with_columns(rows: DataFrame, made: Mapping[str, Column]) -> DataFrame:
    return rows.select("*", *[c.alias(k) for k, c in made.items()])


# Features by name: functions DataFrame -> DataFrame, so users can add theirs.
FeatureStep = Callable[[DataFrame], DataFrame]
REGISTRY: dict[str, FeatureStep] = {}


def register_feature(name: str, step: FeatureStep) -> None:
    REGISTRY[name] = step


def apply_features(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    for name in names:
        rows = REGISTRY[name](rows)
    return rows


# ----------------------------------------- indicators on the bar table itself
def rolling(
    bars: DataFrame, before: int, fn: Callable[[DataFrame, WindowSpec], DataFrame],
    keys: Sequence[str] = KEYS, after: int = 0, cell_s: int = DAY,
) -> DataFrame:
    """Run chained row-frame windows that reach ``before`` rows back in all."""
    return over_blocks(bars, keys, "open_time", before, after, fn, cell_s=cell_s)


def last_rows(w: WindowSpec, k: int) -> WindowSpec:
    return w.rowsBetween(-(k - 1), 0)


def log_step(w: WindowSpec, k: int = 1) -> Column:
    return ln("close") - ln(F.lag("close", k).over(w))


def full_window(w: WindowSpec, k: int, value: Column) -> Column:
    """``value`` once the frame holds ``k`` rows."""
    return F.when(F.count(F.lit(1)).over(last_rows(w, k)) == k, value)


def chart_series(d: DataFrame, w: WindowSpec, n: int = 48) -> DataFrame:
    """Moving averages and MACD over the bars of the last ``n`` rows; averages
    use the rows there are at the left edge."""
    sma = {f"sma_{k}": F.avg("close").over(last_rows(w, k)) for k in (5, 10, 20)}
    d = with_columns(d, sma).withColumn("_c", F.collect_list("close").over(last_rows(w, n)))
    line, signal = arrays.macd(F.col("_c"), n)
    whole = F.size("_c") == n
    d = d.withColumn("macd", F.when(whole, line)).withColumn("macd_signal", F.when(whole, signal))
    return d.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_c")


# Look-backs as multiples of the horizon.
HORIZON_MULTIPLES = (0.25, 0.5, 1.0, 1.5, 2.0, 5.0, 10.0)


def horizon_windows(h: int, minimum: int = 2) -> list[int]:
    """Look-backs in bars for a horizon of ``h`` bars, short ones raised to ``minimum``."""
    return sorted({max(minimum, int(h * m)) for m in HORIZON_MULTIPLES})


def horizon_features(d: DataFrame, w: WindowSpec, h: int) -> DataFrame:
    """Mean, volatility and total of the log steps for every look-back of ``h``."""
    d = d.withColumn("_r", log_step(w))
    made = {}
    for k in horizon_windows(h):
        f = last_rows(w, k)
        made[f"ret_mean_{k}"] = full_window(w, k + 1, F.avg("_r").over(f))
        made[f"ret_std_{k}"] = full_window(w, k + 1, F.stddev_samp("_r").over(f))
        made[f"ret_sum_{k}"] = full_window(w, k + 1, F.sum("_r").over(f))
    return with_columns(d, made).drop("_r")


def trend(d: DataFrame, w: WindowSpec, k: int) -> DataFrame:
    """Return over ``k`` bars over the volatility of the steps at the same scale."""
    d = d.withColumn("_r", log_step(w))
    vol = full_window(w, k + 1, F.stddev_samp("_r").over(last_rows(w, k)))
    return d.withColumn("trend", div(log_step(w, k), vol)).drop("_r")


def zscore(d: DataFrame, w: WindowSpec, k: int) -> DataFrame:
    f = last_rows(w, k)
    z = div(F.col("close") - F.avg("close").over(f), F.stddev_samp("close").over(f))
    return d.withColumn("zscore", full_window(w, k, z))


def percentile_rank(d: DataFrame, w: WindowSpec, k: int) -> DataFrame:
    """Share of the last ``k`` closes that are at most the newest one."""
    d = d.withColumn("_c", F.collect_list("close").over(last_rows(w, k)))
    at_most = F.size(F.filter("_c", lambda x: x <= F.col("close")))
    return d.withColumn("pct_rank", F.when(F.size("_c") == k, at_most / F.lit(float(k)))).drop("_c")


def trailing_rank(
    bars: DataFrame, k: int, value: str = "close", keys: Sequence[str] = KEYS, time: str = "open_time", cell_s: int = DAY,
    ties: Sequence[str] = (), out: str = "pct_rank",
) -> DataFrame:
    """``percentile_rank`` for long windows: the share of the last ``k`` values that are at most the newest.

    A block of rows keeps its window as one sorted run: the oldest value leaves
    it, the newest enters it by binary search, and its place there is the rank,
    so a row costs log ``k`` comparisons, not ``k``.  A block holds about nine
    windows, whatever the length of the group.  NULL while the window is not
    full, or where it holds a NULL or NaN.
    """
    names = [*bars.columns, "_idx", "_block", out]

    def ranked(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_idx", ignore_index=True)
        values = rows[value].astype("float64").tolist()
        run: list[float] = []
        ranks: list[float | None] = []
        for i, v in enumerate(values):
            if i >= k and values[i - k] == values[i - k]:
                del run[bisect_left(run, values[i - k])]
            if v == v:
                insort(run, v)
            ranks.append(bisect_right(run, v) / k if len(run) == k else None)
        rows[out] = pd.Series(ranks, dtype="float64")
        return rows[names]

    def blocks(d: DataFrame, w: WindowSpec) -> DataFrame:
        types = dict(d.dtypes)
        schema = ", ".join(f"`{c}` {types.get(c, 'double')}" for c in names)
        return d.groupBy(*keys, "_block").applyInPandas(ranked, schema).withColumn(out, F.when(~F.isnan(out), F.col(out)))

    return over_blocks(bars, keys, time, k - 1, 0, blocks, ties, cell_s)


def variance_features(d: DataFrame, w: WindowSpec, k: int) -> DataFrame:
    """Realised variance of the log steps and mean log high/low range.

    Undefined steps and ranges, those at a price of 0, are NULL and left out of sum and mean.
    """
    d = d.withColumn("_r", log_step(w)).withColumn("_range", ln(div("high", "low")))
    rv = full_window(w, k + 1, F.sum(F.col("_r") * F.col("_r")).over(last_rows(w, k)))
    rng = full_window(w, k, F.avg("_range").over(last_rows(w, k)))
    return d.withColumn("realised_var", rv).withColumn("range_vol", rng).drop("_r", "_range")


def momentum_features(d: DataFrame, w: WindowSpec, k: int, fast: int = 12, slow: int = 26) -> DataFrame:
    """Least-squares slope of the trailing mean, rate of change, ratio of EMAs over ``slow`` rows."""
    d = d.withColumn("_ma", F.avg("close").over(last_rows(w, k)))
    d = d.withColumn("_mas", F.collect_list("_ma").over(last_rows(w, k)))
    mid = (k - 1) / 2.0
    spread = sum((i - mid) ** 2 for i in range(k))
    slope = arrays.dot(F.col("_mas"), [(i - mid) / spread for i in range(k)])
    d = d.withColumn("_c", F.collect_list("close").over(last_rows(w, slow)))
    ratio = div(arrays.ema(F.col("_c"), slow, fast), arrays.ema(F.col("_c"), slow, slow))
    whole = F.size("_c") == slow
    return with_columns(
        d,
        {
            "ma_slope": F.when(F.size("_mas") == k, slope),
            "rate_of_change": div("close", F.lag("close", k).over(w)) - 1,
            "ema_ratio": F.when(whole, ratio),
        },
    ).drop("_ma", "_mas", "_c")


def activity_features(d: DataFrame, w: WindowSpec, k: int) -> DataFrame:
    """Volume and trade counts against their trailing means, mean trade size,
    and the share of volume in rising bars minus that in falling ones."""
    f = last_rows(w, k)
    signed = F.signum(F.col("close") - F.col("open")) * F.col("volume")
    return with_columns(
        d,
        {
            "volume_ratio": full_window(w, k, div("volume", F.avg("volume").over(f))),
            "trades_ratio": full_window(w, k, div("n_trades", F.avg("n_trades").over(f))),
            "trade_size": div("volume", "n_trades"),
            "imbalance": full_window(w, k, div(F.sum(signed).over(f), F.sum("volume").over(f))),
        },
    )


def target_family(d: DataFrame, w: WindowSpec, h: int) -> DataFrame:
    """Forward targets from one shift: log return, realised volatility,
    direction and sign change against the last step."""
    ahead = w.rowsBetween(1, h)
    d = d.withColumn("_r", log_step(w)).withColumn("_n", F.count(F.lit(1)).over(ahead))
    r = F.col("_r")
    d = d.withColumn("target_return", ln(F.lead("close", h).over(w)) - ln("close"))
    d = d.withColumn("target_vol", F.when(F.col("_n") == h, F.sqrt(F.sum(r * r).over(ahead))))
    d = d.withColumn("target_direction", F.signum("target_return").cast("int"))
    d = d.withColumn(
        "target_flip", F.when(r.isNotNull() & F.col("target_return").isNotNull(), F.signum("target_return") * F.signum(r) < 0)
    )
    return d.drop("_r", "_n")


def cross_asset(left: DataFrame, right: DataFrame, k: int, cell_s: int = DAY, keys: Sequence[str] = ()) -> DataFrame:
    """Step spread, rolling correlation and its change between aligned series.

    ``right`` holds (open_time, close) with one row per time, ``left`` the same
    for each of ``keys``; they are aligned by an equi join on time and then
    windowed in blocks.
    """
    both = left.select(*keys, "open_time", F.col("close").alias("close_a")).join(
        right.select("open_time", F.col("close").alias("close_b")), "open_time"
    )

    def columns(d, w):
        for s in "ab":
            d = d.withColumn(f"_{s}", ln(f"close_{s}") - ln(F.lag(f"close_{s}").over(w)))
        f = last_rows(w, k)
        a, b = F.col("_a"), F.col("_b")
        cov = F.avg(a * b).over(f) - F.avg(a).over(f) * F.avg(b).over(f)
        d = d.withColumn("step_spread", a - b).withColumn(
            "rolling_corr", full_window(w, k + 1, div(cov, F.stddev_pop(a).over(f) * F.stddev_pop(b).over(f)))
        )
        return d.withColumn("corr_change", F.col("rolling_corr") - F.lag("rolling_corr", k).over(w)).drop("_a", "_b")

    return over_blocks(both, list(keys), "open_time", 2 * k + 1, 0, columns, cell_s=cell_s)


def excess_target(bars: DataFrame, benchmark: DataFrame, h: int, keys: Sequence[str] = KEYS, cell_s: int = DAY) -> DataFrame:
    """Log-return target minus that of a benchmark series (open_time, close)."""
    own = log_return_target(bars, h, keys, cell_s).select(*keys, "open_time", "target")
    base = log_return_target(benchmark.withColumn("_one", F.lit(0)), h, ["_one"], cell_s)
    base = base.select("open_time", F.col("target").alias("benchmark_target"))
    return own.join(base, "open_time").withColumn("excess", F.col("target") - F.col("benchmark_target"))


def fit_scaler(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and deviation per key, from the optimisation partition only."""
    aggs = [a for c in columns for a in (F.avg(c).alias(f"_mean_{c}"), F.stddev_samp(c).alias(f"_std_{c}"))]
    return rows.groupBy(*keys).agg(*aggs)


def apply_scaler(rows: DataFrame, stats: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Scale with frozen statistics; the small side is broadcast when its size allows."""
    out = rows.join(stats, list(keys))
    for c in columns:
        out = out.withColumn(f"{c}_scaled", div(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_std_{c}")))
    return out.drop(*[f"_{s}_{c}" for c in columns for s in ("mean", "std")])


def lookahead_audit(
    d: DataFrame, columns: Sequence[str], target: str, w: WindowSpec, shifts: Sequence[int]
) -> DataFrame:
    """Rows (feature value, target moved by each shift), for :func:`shift_correlations`."""
    moved = F.array(
        *[F.struct(F.lit(s).alias("shift"), F.lead(target, s).over(w).alias("moved")) for s in shifts]
    )
    return d.withColumn("_moved", moved)


def shift_correlations(
    rows: DataFrame, columns: Sequence[str], target: str, shifts: Sequence[int],
    keys: Sequence[str] = KEYS, cell_s: int = DAY,
) -> DataFrame:
    """Correlation of each feature with the target at many shifts.

    A feature that knows the future stands out at shifts where it cannot.
    """
    from candlespark.operators.metrics import safe_corr

    reach = max(abs(s) for s in shifts)
    moved = over_blocks(
        rows, keys, "open_time", reach, reach,
        lambda d, w: lookahead_audit(d, columns, target, w, shifts), cell_s=cell_s,
    )
    feats = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in columns])
    long = moved.select(*keys, F.explode("_moved").alias("m"), feats.alias("_f"))
    long = long.select(*keys, "m.shift", F.col("m.moved").alias("y"), F.explode("_f").alias("f"))
    long = long.select(*keys, "shift", "y", "f.feature", "f.x").dropna(subset=["x", "y"])
    return long.groupBy(*keys, "feature", "shift").agg(safe_corr("x", "y").alias("corr"), F.count(F.lit(1)).alias("n"))


def truncation_diff(full: DataFrame, short: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of ``short`` (features of a history cut off early) that differ from
    ``full``; empty when no feature looks ahead."""
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in columns]
    ok = same[0]
    for s in same[1:]:
        ok = ok & s
    on = [F.col(f"s.{k}") == F.col(f"f.{k}") for k in [*keys, "open_time"]]
    joined = short.alias("s").join(full.alias("f"), on, "left")
    return joined.where(~ok).select("s.*")


def universe(bars: DataFrame, min_bars: int, keys: Sequence[str] = KEYS, cell_s: int = DAY) -> DataFrame:
    """Eligibility as of each bar: bars seen so far and time since the first one."""
    from candlespark.operators.blocks import row_index

    first = bars.groupBy(*keys).agg(F.min("open_time").alias("first_time"))
    idx = row_index(bars.select(*keys, "open_time"), keys, "open_time", cell_s=cell_s)
    seen = idx.withColumn("bars_so_far", F.col("row_idx") + 1).drop("row_idx")
    return seen.join(first, list(keys)).withColumn("eligible", F.col("bars_so_far") >= min_bars)
