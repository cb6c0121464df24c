"""Inputs of the registered queries, derived from the given tables.

``ticks`` are the rows of ``events``: one symbol per event type, the value as
the price, ``props.k`` as the size.  A second family of daily bars comes from
``orders``.  Each table has its SQL twin below, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespark.functions.safe import ln
from candlespark.functions.times import bucket
from candlespark.operators.blocks import over_blocks
from candlespark.operators.resample import bars_from_ticks, resample

MONTH = 30 * 86_400  # calendar cell of hourly bars: at most 720 rows
YEAR = 366 * 86_400  # calendar cell of daily bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
        F.col("event_id").alias("seq"),
    )


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), "1h")


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of ``orders``: one symbol per priority, total price as price."""
    orders = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    return resample(
        orders.select(
            F.col("o_orderpriority").alias("symbol"),
            F.col("o_orderdate").alias("open_time"),
            F.col("o_orderkey").alias("seq"),
            *[price.alias(n) for n in ("open", "high", "low", "close")],
            F.lit(1.0).alias("volume"),
            price.alias("quote_volume"),
            F.lit(1).cast("long").alias("n_trades"),
        ),
        "1d",
        ties=["seq"],
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, open_time, y_true, y_pred): next log return against -0.3 x the last one."""

    def columns(rows, w):
        step = ln("close") - ln(F.lag("close").over(w))
        ahead = ln(F.lead("close").over(w)) - ln("close")
        return rows.select("*", ahead.alias("y_true"), (F.lit(-0.3) * step).alias("y_pred"))

    out = over_blocks(
        bars_1h(spark, sf_dir).select("symbol", "open_time", "close"),
        ["symbol"], "open_time", 1, 1, columns, cell_s=MONTH,
    )
    return out.select("symbol", "open_time", "y_true", "y_pred").dropna()


def monitor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        (F.col("user_id") % 5).alias("topic_id"),
        F.concat(F.lit("w"), (F.col("user_id") % 30).cast("string")).alias("address"),
        F.concat(F.lit("d"), F.floor(F.dayofmonth("ts") / 10).cast("string")).alias("deployment_id"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
        F.when(kind.isin("purchase", "error"), "submission")
        .when(kind == "click", "inference")
        .when(kind == "view", "score")
        .otherwise("reward")
        .alias("event_type"),
        F.when(kind.isin("purchase", "click"), "success")
        .when(kind == "error", "error")
        .otherwise("snapshot")
        .alias("status"),
        F.col("value").alias("value_num"),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value_text"),
        F.when(kind.isin("purchase", "error"), F.concat(F.lit("tx"), F.col("event_id").cast("string"))).alias("tx_hash"),
        F.col("ts").alias("observed_at"),
        F.concat(
            F.lit('{"nonce": "'), F.get_json_object("props", "$.k"), F.lit('", "code": '),
            F.when(kind == "error", "5").otherwise("0"), F.lit("}"),
        ).alias("details_json"),
    )


def monitor_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target per (topic, address), with its newest deployment."""
    e = monitor_events(spark, sf_dir)
    return e.groupBy("topic_id", "address").agg(
        F.min("observed_at").alias("deployed_at"),
        F.max_by("deployment_id", "observed_at").alias("deployment_id"),
    )


# --------------------------------------------------------------- SQL twins
TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size, event_id AS seq
  FROM events)"""


def bars_sql(unit: str = "hour", name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT symbol, date_trunc('{unit}', ts)::TIMESTAMP AS open_time,
         first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts, seq) AS close, sum(size) AS volume,
         sum(price * size) AS quote_volume, count(*) AS n_trades
  FROM ticks GROUP BY 1, 2)"""


BARS = TICKS + ", " + bars_sql()

BARS_1D = """bars AS (
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS open_time,
         first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close,
         count(*) * 1.0::DOUBLE AS volume, sum(o_totalprice) AS quote_volume, count(*) AS n_trades
  FROM orders GROUP BY 1, 2)"""

PAIRS = BARS + """, pairs AS (
  SELECT * FROM (
    SELECT symbol, open_time, ln(lead(close) OVER w) - ln(close) AS y_true,
           -0.3 * (ln(close) - ln(lag(close) OVER w)) AS y_pred
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time))
  WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)"""

MONITOR = """mon AS (
  SELECT user_id % 5 AS topic_id, 'w' || (user_id % 30) AS address,
         'd' || CAST(floor(day(ts) / 10) AS INTEGER) AS deployment_id, 'e' || event_id AS event_id,
         CASE WHEN event_type IN ('purchase', 'error') THEN 'submission' WHEN event_type = 'click' THEN 'inference'
              WHEN event_type = 'view' THEN 'score' ELSE 'reward' END AS event_type,
         CASE WHEN event_type IN ('purchase', 'click') THEN 'success' WHEN event_type = 'error' THEN 'error'
              ELSE 'snapshot' END AS status,
         value AS value_num, 'v' || event_id AS value_text,
         CASE WHEN event_type IN ('purchase', 'error') THEN 'tx' || event_id END AS tx_hash,
         ts AS observed_at,
         '{"nonce": "' || json_extract_string(props, '$.k') || '", "code": '
           || CASE WHEN event_type = 'error' THEN '5' ELSE '0' END || '}' AS details_json
  FROM events),
targets AS (
  SELECT topic_id, address, min(observed_at) AS deployed_at, arg_max(deployment_id, observed_at) AS deployment_id
  FROM mon GROUP BY 1, 2)"""
