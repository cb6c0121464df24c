"""Landing jobs: raw candle payloads (JSON text) -> bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespark.schema import BAR_SCHEMA

# Positions in a candle array.
KLINE = {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 5, "quote_volume": 7, "n_trades": 8}

ROW_SCHEMA = (
    "timestamp STRING, values STRUCT<open: DOUBLE, high: DOUBLE, low: DOUBLE, close: DOUBLE, volume: DOUBLE, "
    "trades_done: DOUBLE>, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, trades_done DOUBLE"
)
STREAM_SCHEMA = (
    "data STRUCT<E: BIGINT, k: STRUCT<s: STRING, t: BIGINT, o: STRING, h: STRING, l: STRING, c: STRING, "
    "v: STRING, q: STRING, n: BIGINT, x: BOOLEAN>>"
)


def _millis(ms: Column) -> Column:
    return F.timestamp_millis(ms.try_cast("long"))


def land_klines(payloads: DataFrame, symbol: str = "symbol", payload: str = "payload", ntz: bool = True) -> DataFrame:
    """(symbol, payload) with an array of candle arrays per payload -> bars.

    Numbers come as strings; values that are no numbers become NULL.
    """
    arrays = F.from_json(F.col(payload), "ARRAY<ARRAY<STRING>>")
    rows = payloads.select(F.col(symbol).alias("symbol"), F.explode(arrays).alias("k"))
    time = _millis(F.get("k", F.lit(0)))
    out = [F.col("symbol"), (time.cast("timestamp_ntz") if ntz else time).alias("open_time")]
    for f in BAR_SCHEMA.fields[2:]:
        kind = "long" if f.name == "n_trades" else "double"
        out.append(F.get("k", F.lit(KLINE[f.name])).try_cast(kind).alias(f.name))
    return rows.select(*out)


def land_rows(payloads: DataFrame, symbol: str = "symbol", payload: str = "payload") -> DataFrame:
    """(symbol, payload) with one row object per payload, nested or flat.

    Missing prices become NaN, missing volume and trades 0.
    """
    rows = payloads.select(F.col(symbol).alias("symbol"), F.from_json(payload, ROW_SCHEMA).alias("r"))

    def value(name: str, default: float) -> Column:
        return F.coalesce(F.col(f"r.values.{name}"), F.col(f"r.{name}"), F.lit(default)).alias(name)

    nan = float("nan")
    return rows.select(
        "symbol",
        F.try_to_timestamp(F.col("r.timestamp")).cast("timestamp_ntz").alias("open_time"),
        *[value(n, nan) for n in ("open", "high", "low", "close")],
        value("volume", 0.0),
        F.lit(None).cast("double").alias("quote_volume"),
        value("trades_done", 0.0).cast("long").alias("n_trades"),
    )


def land_stream_klines(messages: DataFrame, payload: str = "value") -> DataFrame:
    """Stream messages -> bars with TIMESTAMP times; candles still open are dropped.

    ``arrival`` is the time at which the exchange sent the message, in milliseconds.
    """
    k = messages.select(F.from_json(F.col(payload).cast("string"), STREAM_SCHEMA).alias("m")).select("m.data.k.*", F.col("m.data.E").alias("arrival"))
    num = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "quote_volume": "q"}
    return k.where("x").select(
        F.col("s").alias("symbol"),
        F.timestamp_millis("t").alias("open_time"),
        *[F.col(c).try_cast("double").alias(n) for n, c in num.items()],
        F.col("n").alias("n_trades"),
        "arrival",
    )


def clean(bars: DataFrame) -> DataFrame:
    """Missing volume -> 0; rows with a missing or NaN price are dropped."""
    volume = F.coalesce(F.when(~F.isnan("volume"), F.col("volume")), F.lit(0.0))
    prices = ["open", "high", "low", "close"]
    out = bars.withColumn("volume", volume)
    for c in prices:
        out = out.where(F.col(c).isNotNull() & ~F.isnan(c))
    return out
