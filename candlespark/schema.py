"""Logical schemas: one row per bar, UTC wall-clock times."""

from pyspark.sql import types as T

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("open_time", T.TimestampNTZType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("quote_volume", T.DoubleType()),
        T.StructField("n_trades", T.LongType()),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("topic_id", T.LongType()),
        T.StructField("address", T.StringType()),
        T.StructField("deployment_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("value_num", T.DoubleType()),
        T.StructField("value_text", T.StringType()),
        T.StructField("tx_hash", T.StringType()),
        T.StructField("observed_at", T.TimestampNTZType()),
        T.StructField("details_json", T.StringType()),
    ]
)

EVENT_KEY = ["topic_id", "address", "event_id"]

# Bar fields in the order used by feature names.
BAR_FIELDS = ["open", "high", "low", "close", "volume"]
