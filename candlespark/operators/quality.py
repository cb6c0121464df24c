"""Completeness, gaps and profiles of a bar table; backfill planning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespark.functions.safe import div
from candlespark.functions.times import MICRO, from_micros, micros
from candlespark.operators.blocks import DAY, over_blocks, value_ranks
from candlespark.operators.metrics import safe_corr

KEYS = ("symbol",)

# History start, month rule, audit limits.
EPOCH_START = "2020-01-01 00:00:00"
DAYS_PER_MONTH_REQUEST = 7
MIN_COVERAGE = 0.85
MAX_LAG_MINUTES = 15


def day_counts(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return bars.groupBy(*keys, F.to_date("open_time").alias("dt")).agg(F.count(F.lit(1)).alias("n_bars"))


def complete_days(bars: DataFrame, expected: int, keys: Sequence[str] = KEYS) -> DataFrame:
    return day_counts(bars, keys).where(F.col("n_bars") == expected)


def incomplete_days(bars: DataFrame, start: str, expected: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Calendar days in [start, day of the newest bar) that are not complete.

    Days without any bar are included.
    """
    days = day_counts(bars, keys)
    last = days.groupBy(*keys).agg(F.max("dt").alias("_last"))
    first = F.to_date(F.lit(start))
    calendar = last.where(F.col("_last") > first).select(
        *keys, F.explode(F.sequence(first, F.date_sub("_last", 1))).alias("dt")
    )
    return calendar.join(days.where(F.col("n_bars") == expected), [*keys, "dt"], "left_anti")


def backfill_plan(bars: DataFrame, start: str, as_of: Column, expected: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Requests (kind, from_time, to_time, days) that complete each history.

    A month with up to seven missing days gets one request per day, any other
    month one request for the whole month with its day list; the tail runs
    from just after the newest bar to ``as_of``.
    """
    keys = list(keys)
    missing = incomplete_days(bars, start, expected, keys).withColumn("_month", F.trunc("dt", "month"))
    months = missing.groupBy(*keys, "_month").agg(F.sort_array(F.collect_list("dt")).alias("days"))  # at most 31 days
    few = F.size("days") <= DAYS_PER_MONTH_REQUEST
    one_day = F.transform("days", lambda d: F.struct(d.alias("lo"), F.date_add(d, 1).alias("hi"), F.array(d).alias("days")))
    one_month = F.array(F.struct(F.col("_month").alias("lo"), F.add_months("_month", 1).alias("hi"), F.col("days").alias("days")))
    parts = months.select(
        *keys, F.when(few, "day").otherwise("month").alias("kind"), F.explode(F.when(few, one_day).otherwise(one_month)).alias("p")
    )

    def end(day: Column) -> Column:
        return from_micros(micros(day.cast("timestamp_ntz")) - 1)

    ranges = parts.select(
        *keys, "kind", F.col("p.lo").cast("timestamp_ntz").alias("from_time"), end(F.col("p.hi")).alias("to_time"),
        F.col("p.days").alias("days"),
    )
    newest = bars.groupBy(*keys).agg(F.max("open_time").alias("_t"))
    tail = newest.select(
        *keys, F.lit("tail").alias("kind"), from_micros(micros("_t") + 1000).alias("from_time"),
        as_of.alias("to_time"), F.array().cast("array<date>").alias("days"),
    )
    return ranges.unionByName(tail)


def first_request(wanted: DataFrame, bars: DataFrame, start: str, as_of: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Whole-history requests for wanted keys that have no bars at all."""
    none = wanted.join(bars.select(*keys).distinct(), list(keys), "left_anti")
    return none.select(
        *keys, F.lit("full").alias("kind"), F.lit(start).cast("timestamp_ntz").alias("from_time"), as_of.alias("to_time"),
        F.array().cast("array<date>").alias("days"),
    )


def chunk_ranges(ranges: DataFrame, days: int) -> DataFrame:
    """Cut each (from_time, to_time) into chunks of ``days``; a chunk starts one
    second after the previous one's end."""
    step = days * DAY * MICRO
    lo, hi = micros("from_time"), micros("to_time")
    starts = F.sequence(lo, hi, F.lit(step + MICRO))
    out = ranges.withColumn("_s", F.explode(F.when(lo < hi, starts)))
    return (
        out.withColumn("chunk_start", from_micros(F.col("_s")))
        .withColumn("chunk_end", from_micros(F.least(F.col("_s") + step, hi)))
        .where(F.col("_s") < hi)
        .drop("_s")
    )


def resume_points(wanted: DataFrame, bars: DataFrame, interval_s: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Where to continue: the newest bar (written again), else the history start."""
    newest = bars.groupBy(*keys).agg(F.max("open_time").alias("_t"))
    back = from_micros(micros("_t") - interval_s * MICRO)
    start = F.coalesce(back, F.lit(EPOCH_START).cast("timestamp_ntz"))
    return wanted.join(newest, list(keys), "left").select(*keys, start.alias("resume_at"))


def gaps(bars: DataFrame, keys: Sequence[str] = KEYS, cell_s: int = DAY) -> DataFrame:
    """Seconds since the previous bar of each key."""

    def columns(d, w):
        return d.withColumn("gap_s", (micros("open_time") - micros(F.lag("open_time").over(w))) / F.lit(float(MICRO)))

    return over_blocks(bars.select(*keys, "open_time"), keys, "open_time", 1, 0, columns, cell_s=cell_s)


def resolution_audit(bars: DataFrame, interval_s: int, as_of: Column, keys: Sequence[str] = KEYS, cell_s: int = DAY) -> DataFrame:
    """Usual and largest step, order, coverage of the expected bars, lag to ``as_of``."""
    keys = list(keys)
    steps = gaps(bars, keys, cell_s)
    # Counted per (key, step): the usual step is the most frequent, smallest on ties.
    kinds = steps.where("gap_s IS NOT NULL").groupBy(*keys, "gap_s").agg(F.count(F.lit(1)).alias("_n"))
    usual = kinds.groupBy(*keys).agg(
        F.max_by("gap_s", F.struct(F.col("_n"), -F.col("gap_s"))).alias("usual_step_s"),
        F.max("gap_s").alias("largest_step_s"),
        (F.min("gap_s") > 0).alias("increasing"),
    )
    span = bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"), F.min(micros("open_time")).alias("_lo"), F.max(micros("open_time")).alias("_hi")
    )
    expected = ((F.col("_hi") - F.col("_lo")) / F.lit(interval_s * MICRO)).cast("long") + 1
    lag = (micros(as_of) - F.col("_hi")) / F.lit(60.0 * MICRO)
    return span.join(usual, keys, "left").select(
        *keys, "n_bars", expected.alias("n_expected"), div("n_bars", expected).alias("coverage"), lag.alias("lag_minutes"),
        "usual_step_s", "largest_step_s", "increasing",
        ((div("n_bars", expected) >= MIN_COVERAGE) & (lag <= MAX_LAG_MINUTES)).alias("usable"),
    )


def profile(bars: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows, date range, and per column null rate, moments and quartiles, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time")]
    for c in columns:
        aggs += [
            F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_null_rate"), F.avg(c).alias(f"{c}_mean"),
            F.stddev_pop(c).alias(f"{c}_std"), F.skewness(c).alias(f"{c}_skew"), F.kurtosis(c).alias(f"{c}_kurtosis"),
            F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
        ]
    return bars.groupBy(*keys).agg(*aggs)


def quantiles(bars: DataFrame, column: str, shares: Sequence[float], keys: Sequence[str] = KEYS) -> DataFrame:
    """Quantiles as exact order statistics, however large a group is: the least value that enough rows do not exceed."""
    ranks = value_ranks(bars.where(F.col(column).isNotNull()), keys, column)
    upto = F.col("n_less") + F.col("n_equal")
    picks = [F.min(F.when(upto >= s * F.col("n_group"), F.col(column))).alias(f"q{round(s * 100)}") for s in shares]
    return ranks.groupBy(*keys).agg(*picks)


def autocorrelation(
    rows: DataFrame, value: str, lags: Sequence[int], keys: Sequence[str] = KEYS, cell_s: int = DAY
) -> DataFrame:
    """Correlation of a series with itself at several lags."""

    def columns(d, w):
        pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag(value, k).over(w).alias("past")) for k in lags])
        return d.withColumn("_p", pairs)

    d = over_blocks(rows.select(*keys, "open_time", value), keys, "open_time", max(lags), 0, columns, cell_s=cell_s)
    long = d.select(*keys, F.col(value).alias("x"), F.explode("_p").alias("p")).select(*keys, "x", "p.lag", "p.past")
    return long.dropna().groupBy(*keys, "lag").agg(safe_corr("x", "past").alias("autocorr"), F.count(F.lit(1)).alias("n"))


def sanity(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts of bars that break price rules."""
    o, h, lo, c = (F.col(n) for n in ("open", "high", "low", "close"))
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.count_if((lo > o) | (lo > c)).alias("low_above"),
        F.count_if((h < o) | (h < c)).alias("high_below"),
        F.count_if((o <= 0) | (h <= 0) | (lo <= 0) | (c <= 0)).alias("not_positive"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
    )
