"""Interval strings and integer time arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Minutes per interval unit.
UNIT_MINUTES = {"m": 1, "min": 1, "h": 60, "d": 1440}

MICRO = 1_000_000


def interval_minutes(freq: str) -> int:
    """``"5m" -> 5``, ``"15min" -> 15``, ``"1h" -> 60``, ``"1d" -> 1440``."""
    match = re.fullmatch(r"(\d+)(min|m|h|d)", freq.strip().lower())
    if not match or int(match.group(1)) < 1:
        raise ValueError(f"not an interval: {freq!r}")
    return int(match.group(1)) * UNIT_MINUTES[match.group(2)]


def micros(time: Column | str) -> Column:
    """Microseconds since the epoch, for both timestamp types."""
    col = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(col.cast("timestamp"))


def from_micros(value: Column, ntz: bool = True) -> Column:
    out = F.timestamp_micros(value)
    return out.cast("timestamp_ntz") if ntz else out


def is_ntz(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.TimestampNTZType)


def floor_micros(value: Column, width_s: int, offset_us: Column | int = 0) -> Column:
    """Start of the ``width_s`` bucket that holds ``value`` (micros)."""
    off = F.lit(offset_us) if isinstance(offset_us, int) else offset_us
    return value - F.pmod(value - off, F.lit(width_s * MICRO))


def bucket(df: DataFrame, time: str, width_s: int, offset_us: Column | int = 0) -> Column:
    """Bucket start with the timestamp type of ``df[time]``."""
    return from_micros(floor_micros(micros(time), width_s, offset_us), is_ntz(df, time))


def cell(time: Column | str, width_s: int) -> Column:
    """Number of the calendar cell that holds ``time``."""
    return F.floor(micros(time) / F.lit(width_s * MICRO)).cast("long")


def add_seconds(time: Column, seconds: Column | int) -> Column:
    sec = F.lit(seconds) if isinstance(seconds, int) else seconds
    return from_micros(micros(time) + sec * MICRO)
