"""Hot cache: the last K whole bars per symbol as streaming state."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NUMBERS = ["open", "high", "low", "close", "volume", "quote_volume"]
BAR = "open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, quote_volume DOUBLE, n_trades BIGINT, arrival BIGINT"
FIELDS = [*NUMBERS, "n_trades", "arrival"]
ROW_SCHEMA = f"symbol STRING, open_time TIMESTAMP, {BAR}"
OUT_SCHEMA = (
    "symbol STRING, n_cached INT, first_time TIMESTAMP, last_time TIMESTAMP, last_open DOUBLE, last_high DOUBLE, last_low DOUBLE, last_close DOUBLE, "
    "last_n_trades BIGINT, max_high DOUBLE, min_low DOUBLE, mean_close DOUBLE, volume DOUBLE, n_trades BIGINT"
)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Processors with named states need the RocksDB state store; a query keeps the store it began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _clean(x, kind=float):
    return None if x is None or pd.isna(x) else kind(x)


def bar_of(row) -> tuple:
    """The state's value of a row of a pandas frame."""
    return (*[_clean(getattr(row, c)) for c in NUMBERS], _clean(row.n_trades, int), _clean(row.arrival, int))


def later(new: tuple, old: tuple | None) -> bool:
    """Whether a bar that came after ``old`` replaces it: always, unless both say when they were sent and it was sent before."""
    return old is None or new[-1] is None or old[-1] is None or new[-1] >= old[-1]


def rank(bar: tuple) -> tuple:
    """The order of copies that come together: sent last, then more trades, then the larger values."""
    order = [bar[7], bar[6], bar[4], bar[3], bar[1], bar[2], bar[0]]
    return tuple((x is not None, 0 if x is None else x) for x in order)


class Cache(StatefulProcessor):
    """State of a symbol: at most ``size`` bars by time."""

    def __init__(self, size: int, rows: bool):
        self.size, self.rows = size, rows

    def init(self, handle) -> None:
        self.bars = handle.getMapState("bars", "us BIGINT", BAR)

    def _merge(self, frames) -> dict[int, tuple]:
        held = {k[0]: tuple(v) for k, v in self.bars.iterator()}
        before = dict(held)
        arrived: dict[int, tuple] = {}
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                us, bar = int(row.us), bar_of(row)
                if us not in arrived or rank(bar) > rank(arrived[us]):
                    arrived[us] = bar
            for us in sorted(arrived)[: -self.size]:
                del arrived[us]
        for us, bar in arrived.items():
            if later(bar, held.get(us)):
                held[us] = bar
        for us in sorted(held)[: -self.size]:
            del held[us]
        for us in before.keys() - held.keys():
            self.bars.removeKey((us,))
        for us, bar in held.items():
            if before.get(us) != bar:
                self.bars.updateValue((us,), bar)
        return held

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._merge([initialState])

    def handleInputRows(self, key, rows, timerValues):
        held = self._merge(rows)
        times = sorted(held)
        bars = [held[us] for us in times]
        stamps = pd.to_datetime(times, unit="us")
        if self.rows:
            columns = {c: pd.Series([b[i] for b in bars], dtype="Int64" if i > 5 else "float64") for i, c in enumerate(FIELDS)}
            yield pd.DataFrame({"symbol": key[0], "open_time": stamps, **columns})
            return
        last = bars[-1]

        def known(i):
            return [b[i] for b in bars if b[i] is not None]

        closes = known(3)
        yield pd.DataFrame(
            {
                "symbol": [key[0]], "n_cached": [len(bars)], "first_time": [stamps[0]], "last_time": [stamps[-1]],
                "last_open": [last[0]], "last_high": [last[1]], "last_low": [last[2]], "last_close": [last[3]], "last_n_trades": pd.Series([last[6]], dtype="Int64"),
                "max_high": [max(known(1), default=None)], "min_low": [min(known(2), default=None)],
                "mean_close": [sum(closes) / len(closes) if closes else None], "volume": [sum(known(4))], "n_trades": [sum(known(6))],
            }
        )

    def close(self) -> None:
        pass


def hot_cache(bars: DataFrame, size: int = 1000, preload: DataFrame | None = None, rows: bool = False) -> DataFrame:
    """Keep the newest ``size`` whole bars per symbol; a bar of the same time is replaced by the later copy.

    ``preload``: stored bars that the cache begins with, so that the first
    micro-batch already sees full histories; only the newest ``size`` per symbol
    are read into the state.  Emits, for every symbol that had rows, a summary
    or, with ``rows``, all bars it holds.  The state of a symbol is bounded by
    ``size``.
    """
    keep_state_on_disk(bars.sparkSession)

    def shaped(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        time = F.col("open_time").cast("timestamp")
        values = [(F.col(c) if c in have else F.lit(None)).cast("double" if c in NUMBERS else "long").alias(c) for c in FIELDS]
        return df.where(time.isNotNull()).select("symbol", F.unix_micros(time).alias("us"), *values)

    begin = None
    if preload is not None:
        from candlespark.sources.bars import newest_rows

        begin = shaped(newest_rows(preload, size)).groupBy("symbol")
    return shaped(bars).groupBy("symbol").transformWithStateInPandas(
        Cache(size, rows), ROW_SCHEMA if rows else OUT_SCHEMA, "Update", "None", begin
    )
