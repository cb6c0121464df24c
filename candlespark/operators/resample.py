"""Bars from ticks or finer bars: resampling, live alignment, densifying."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.functions.times import MICRO, bucket, floor_micros, from_micros, interval_minutes, is_ntz, micros
from candlespark.operators.blocks import DAY, carry_last

Agg = str | Callable[[Column], Column]

# How each bar field is combined.
OHLCV = {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}
OHLCV_TRADES = {**OHLCV, "quote_volume": "sum", "n_trades": "sum"}


def _aggregate(name: str, how: Agg, order: Column) -> Column:
    col = F.col(name)
    if callable(how):
        return how(col).alias(name)
    made = {
        "first": lambda: F.min_by(col, order),
        "last": lambda: F.max_by(col, order),
        "max": lambda: F.max(col),
        "min": lambda: F.min(col),
        "sum": lambda: F.coalesce(F.sum(col), F.lit(0)),
        "mean": lambda: F.avg(col),
        "count": lambda: F.count(col),
    }
    return made[how]().alias(name)


def _order(df: DataFrame, time: str, ties: Sequence[str]) -> Column:
    """What open and close go by.

    One integer tie-break is folded into a decimal with the time: unlike a
    struct, its type stays in the hash aggregate, where a struct would force
    every input split to be sorted.
    """
    if not ties:
        return F.col(time)
    kinds = dict(df.dtypes)
    if len(ties) == 1 and kinds[ties[0]] in ("bigint", "int"):
        step = F.lit("20000000000000000000").cast("decimal(20,0)")  # more than the range of a bigint
        return micros(time).cast("decimal(19,0)") * step + F.col(ties[0])
    return F.struct(time, *ties)


def resample(
    bars: DataFrame,
    freq: str,
    keys: Sequence[str] = ("symbol",),
    aggs: Mapping[str, Agg] = OHLCV_TRADES,
    time: str = "open_time",
    ties: Sequence[str] = (),
    offset_minutes: Column | int = 0,
) -> DataFrame:
    """Combine rows into ``freq`` buckets per key.

    Rows of a key are partially combined before the shuffle.  Stored bars have
    one row per (key, time), so open and close order by time alone; ticks name
    their tie-breaking columns in ``ties``.
    """
    width = interval_minutes(freq) * 60
    off = offset_minutes * 60 * MICRO
    order = _order(bars, time, ties)
    slot = bucket(bars, time, width, off)
    return (
        bars.withColumn("_slot", slot)
        .groupBy(*keys, "_slot")
        .agg(*[_aggregate(n, h, order) for n, h in aggs.items()])
        .withColumnRenamed("_slot", time)
    )


def bars_from_ticks(ticks: DataFrame, freq: str) -> DataFrame:
    """Ticks (symbol, ts, price, size, seq) -> bars."""
    one = ticks.select(
        "symbol",
        F.col("ts").alias("open_time"),
        "seq",
        *[F.col("price").alias(n) for n in ("open", "high", "low", "close")],
        F.col("size").alias("volume"),
        (F.col("price") * F.col("size")).alias("quote_volume"),
        F.lit(1).cast("long").alias("n_trades"),
    )
    return resample(one, freq, ties=["seq"])


def drop_incomplete(
    bars: DataFrame, as_of: Column, keys: Sequence[str] = ("symbol",), time: str = "open_time"
) -> DataFrame:
    """Drop each key's newest row when its minute is still open at ``as_of``.

    The newest row goes when it lies after ``as_of``, or in the same minute
    while fewer than 45 seconds of it have passed.
    """
    newest = bars.groupBy(*keys).agg(F.max(time).alias("_newest"))
    newest_us, now_us = micros("_newest"), micros(as_of)
    same = floor_micros(newest_us, 60) == floor_micros(now_us, 60)
    open_minute = (newest_us > now_us) | (same & (F.pmod(now_us, F.lit(60 * MICRO)) < 45 * MICRO))
    return (
        bars.join(newest.withColumn("_open", open_minute), list(keys))
        .where(~(F.col("_open") & (F.col(time) == F.col("_newest"))))
        .drop("_newest", "_open")
    )


def resample_live(
    bars: DataFrame,
    freq: str,
    as_of: Column,
    keys: Sequence[str] = ("symbol",),
    aggs: Mapping[str, Agg] = OHLCV_TRADES,
    time: str = "open_time",
    all_intervals: bool = False,
) -> DataFrame:
    """Resample so that the newest bar of each key ends at its newest row.

    The shift is (newest minute + 1) mod interval.  By default it applies to
    minute intervals only, hours and days stay aligned with the clock;
    ``all_intervals`` applies it to every interval.
    """
    done = drop_incomplete(bars, as_of, keys, time)
    minutes = interval_minutes(freq)
    if minutes >= 60 and not all_intervals:
        return resample(done, freq, keys, aggs, time)
    newest = done.groupBy(*keys).agg(F.max(time).alias("_newest"))
    newest = newest.select(*keys, F.pmod(F.minute("_newest") + 1, F.lit(minutes)).cast("long").alias("_off"))
    out = resample(done.join(newest, list(keys)), freq, [*keys, "_off"], aggs, time, offset_minutes=F.col("_off"))
    return out.drop("_off")


def snapshot(
    bars: DataFrame, freq: str, as_of: Column, keys: Sequence[str] = ("symbol",), time: str = "open_time"
) -> DataFrame:
    """Newest bar per key that had closed at ``as_of``."""
    width = interval_minutes(freq) * 60 * MICRO
    closed = resample(bars, freq, keys, time=time).where(micros(time) + width <= micros(as_of))
    fields = [c for c in closed.columns if c not in keys]
    newest = closed.groupBy(*keys).agg(F.max_by(F.struct(*fields), time).alias("_bar"))
    return newest.select(*keys, "_bar.*")


def first_per_bucket(
    rows: DataFrame, keys: Sequence[str], time: str, value: str, width_s: int = 300, ties: Sequence[str] = ()
) -> DataFrame:
    """One value per (keys, bucket): the first one seen in the bucket."""
    number = F.floor(micros(time) / F.lit(width_s * MICRO)).cast("long")
    order = F.struct(time, *ties) if ties else F.col(time)
    return (
        rows.withColumn("bucket", number)
        .groupBy(*keys, "bucket")
        .agg(F.min_by(value, order).alias(value), F.min(time).alias(time))
    )


def grid(bars: DataFrame, freq: str, keys: Sequence[str] = ("symbol",), time: str = "open_time") -> DataFrame:
    """Every grid time between each key's first and last bar.

    The sequence is built per day, so no row holds a key's whole calendar.
    """
    ntz, step = is_ntz(bars, time), interval_minutes(freq) * 60 * MICRO
    day = DAY * MICRO
    span = bars.groupBy(*keys).agg(F.min(micros(time)).alias("_lo"), F.max(micros(time)).alias("_hi"))
    chunk = step * max(1, day // step)
    days = span.withColumn("_day", F.explode(F.sequence("_lo", "_hi", F.lit(chunk))))
    ticks = F.sequence(
        F.col("_day"), F.least(F.col("_day") + (chunk - step), F.col("_hi")), F.lit(step)
    )
    return days.select(*keys, F.explode(ticks).alias("_us")).select(
        *keys, from_micros(F.col("_us"), ntz).alias(time)
    )


def densify(
    bars: DataFrame,
    freq: str,
    keys: Sequence[str] = ("symbol",),
    time: str = "open_time",
    how: str = "ffill",
    value: str = "close",
) -> DataFrame:
    """Fill missing grid times of ``value`` explicitly.

    ``ffill`` repeats the last value, ``drop`` leaves NULL, ``linear``
    interpolates between the neighbours.  ``observed`` marks real rows.
    """
    full = grid(bars, freq, keys, time).join(bars.select(*keys, time, value), [*keys, time], "left")
    full = full.withColumn("observed", F.col(value).isNotNull())
    if how == "drop":
        return full
    cell_s = max(DAY, 64 * interval_minutes(freq) * 60)
    past = carry_last(
        full.withColumn("_at", F.when(F.col("observed"), F.struct(micros(time).alias("us"), F.col(value).alias("v")))),
        keys, time, "_at", "_prev", cell_s=cell_s,
    )
    if how == "ffill":
        return past.withColumn(value, F.col("_prev.v")).drop("_at", "_prev")
    # The next value is the last one on the reversed time axis.
    back = past.withColumn("_back", from_micros(-micros(time)))
    both = carry_last(back, keys, "_back", "_at", "_next", cell_s=cell_s)
    share = (micros(time) - F.col("_prev.us")) / F.nullif(F.col("_next.us") - F.col("_prev.us"), F.lit(0))
    line = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * share
    return both.withColumn(value, F.coalesce(F.col(value), line)).drop("_at", "_prev", "_next", "_back")
