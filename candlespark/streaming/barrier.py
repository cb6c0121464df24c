"""Completeness barrier: one row per open time when every tracked symbol reported.

``barrier`` waits for the watermark and is pure SQL.  ``eager_barrier`` fires
in the batch that completes an open time, or at the timeout with the missing
symbols named; :func:`fill_missing` then takes their bars from a static table.
``clock_barrier`` counts the timeout on the clock, so that a feed that stops
still fires, and fills from its own state.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from candlespark.functions.times import interval_minutes
from candlespark.streaming.cache import BAR, bar_of, keep_state_on_disk, later, rank

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUT_SCHEMA = "open_time TIMESTAMP, n_symbols INT, complete BOOLEAN, missing ARRAY<STRING>"
STATE_SCHEMA = "seen ARRAY<STRING>, fired BOOLEAN"


def barrier(bars: DataFrame, symbols: Sequence[str], time: str = "open_time", freq: str = "1m") -> DataFrame:
    """Open times closed by the watermark, with the symbols that are missing.

    The state holds at most the tracked symbols per open time.
    """
    tracked = F.array(*[F.lit(s) for s in sorted(symbols)])
    seen = bars.where(F.col("symbol").isin(*symbols)).groupBy(F.window(time, f"{interval_minutes(freq)} minutes").alias("_w")).agg(F.collect_set("symbol").alias("_s"))
    missing = F.array_sort(F.array_except(tracked, F.col("_s")))
    return seen.select(
        F.col("_w.start").alias(time), F.size("_s").alias("n_symbols"), (F.size(missing) == 0).alias("complete"), missing.alias("missing"),
    )


def eager_barrier(bars: DataFrame, symbols: Sequence[str], timeout_s: int = 20) -> DataFrame:
    """Fire once per open time: on completion, else ``timeout_s`` of event time later.

    A group is one open time and its state a set of tracked symbols.
    """
    tracked = sorted(symbols)

    def step(key, frames, state: GroupState):
        (at,) = key
        seen, fired = state.get if state.exists else ([], False)
        seen = set(seen)
        if state.hasTimedOut:
            state.remove()
            if not fired:
                missing = [s for s in tracked if s not in seen]
                yield pd.DataFrame({"open_time": [at], "n_symbols": [len(seen)], "complete": [not missing], "missing": [missing]})
            return
        for pdf in frames:
            seen.update(s for s in pdf["symbol"] if s in tracked)
        if not fired and len(seen) == len(tracked):
            fired = True
            yield pd.DataFrame({"open_time": [at], "n_symbols": [len(seen)], "complete": [True], "missing": [[]]})
        state.update((sorted(seen), fired))
        due = int(pd.Timestamp(at).timestamp() * 1000) + timeout_s * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return bars.select("symbol", "open_time").groupBy("open_time").applyInPandasWithState(
        step, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
    )


def fill_missing(fired: DataFrame, static_bars: DataFrame, time: str = "open_time") -> DataFrame:
    """Bars of the missing symbols from a static table, marked ``filled``."""
    want = fired.select(time, F.explode("missing").alias("symbol"))
    return want.join(static_bars, ["symbol", time]).withColumn("filled", F.lit(True))


CLOCK_SCHEMA = (
    "source STRING, open_time TIMESTAMP, n_symbols INT, complete BOOLEAN, missing ARRAY<STRING>, "
    f"bars ARRAY<STRUCT<symbol: STRING, bar_time: TIMESTAMP, filled: BOOLEAN, {BAR.replace(' ', ': ').replace(',: ', ', ')}>>"
)


class ClockBarrier(StatefulProcessor):
    """State of a source: what came for the newest ``keep`` open times, and which of them have fired."""

    def __init__(self, symbols: list[str], timeout_s: float, width_us: int, keep: int):
        self.symbols, self.timeout_ms, self.width, self.keep = symbols, int(timeout_s * 1000), width_us, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.times = handle.getMapState("times", "us BIGINT", "due BIGINT, fired BOOLEAN")
        self.bars = handle.getMapState("bars", "us BIGINT, symbol STRING", BAR)

    def _known(self) -> dict[int, tuple]:
        return {k[0]: tuple(v) for k, v in self.times.iterator()}

    def _fire(self, source: str, us: int, known: dict[int, tuple]) -> dict:
        """The snapshot of an open time; missing bars are the symbol's last ones before it."""
        out, missing = [], []
        earlier = sorted((t for t in known if t <= us), reverse=True)
        for s in self.symbols:
            at = next((t for t in earlier if self.bars.containsKey((t, s))), None)
            if at != us:
                missing.append(s)
            if at is not None:
                out.append((s, pd.Timestamp(at, unit="us"), at != us, *self.bars.getValue((at, s))))
        known[us] = (known[us][0], True)
        self.times.updateValue((us,), known[us])
        return {"source": source, "open_time": pd.Timestamp(us, unit="us"), "n_symbols": len(self.symbols) - len(missing), "complete": not missing,
                "missing": missing, "bars": out}

    def handleInputRows(self, key, rows, timerValues):
        now, known, came = timerValues.getCurrentProcessingTimeInMs(), self._known(), {}
        for pdf in rows:
            for row in pdf.itertuples(index=False):
                at, bar = (int(row.us) // self.width * self.width, row.symbol), bar_of(row)
                if at not in came or rank(bar) > rank(came[at]):
                    came[at] = bar
        fresh = {us for us, _ in came} - known.keys()
        for us in fresh:
            known[us] = (now + self.timeout_ms, False)
        oldest = sorted(known)[: -self.keep]
        for us in fresh - set(oldest):
            self.times.updateValue((us,), known[us])
        if fresh - set(oldest):
            self.handle.registerTimer(now + self.timeout_ms)
        for (us, s), bar in came.items():
            if us not in oldest and later(bar, tuple(self.bars.getValue((us, s))) if us not in fresh and self.bars.containsKey((us, s)) else None):
                self.bars.updateValue((us, s), bar)
        # Open times that fall out of the state fire first, as they are.
        fired = [self._fire(key[0], us, known) for us in oldest if us not in fresh and not known[us][1]]
        for us in oldest:
            del known[us]
            if us not in fresh:
                self.times.removeKey((us,))
                for s in self.symbols:
                    if self.bars.containsKey((us, s)):
                        self.bars.removeKey((us, s))
        for us in sorted({us for us, _ in came} & known.keys()):
            if not known[us][1] and all(self.bars.containsKey((us, s)) for s in self.symbols):
                fired.append(self._fire(key[0], us, known))
        if fired:
            yield pd.DataFrame(fired)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        known = self._known()
        due = expiredTimerInfo.getExpiryTimeInMs()
        fired = [self._fire(key[0], us, known) for us in sorted(known) if not known[us][1] and known[us][0] <= due]
        if fired:
            yield pd.DataFrame(fired)

    def close(self) -> None:
        pass


def clock_barrier(
    bars: DataFrame, symbols: Sequence[str], timeout_s: float = 20, freq: str = "1m", keep: int = 1000, source: Column | None = None,
) -> DataFrame:
    """One snapshot per open time: when all tracked symbols reported, else ``timeout_s`` seconds of the clock after the first.

    A snapshot fires once; bars of the missing symbols are their last ones
    before it, marked ``filled``.  ``freq`` is the bars' width.  Of each
    ``source`` (all bars are one without it) the state holds ``keep`` open times
    of the tracked symbols, which are a fixed list; older ones fire as they
    are, and rows that come after that are dropped.
    """
    keep_state_on_disk(bars.sparkSession)
    have = set(bars.columns)
    fields = [part.split() for part in BAR.split(", ")]
    values = [(F.col(n) if n in have else F.lit(None)).cast(kind).alias(n) for n, kind in fields]
    rows = bars.where(F.col("symbol").isin(*symbols) & F.col("open_time").isNotNull()).select(
        (F.lit("") if source is None else source).alias("source"), "symbol", F.unix_micros(F.col("open_time").cast("timestamp")).alias("us"), *values
    )
    processor = ClockBarrier(sorted(symbols), timeout_s, interval_minutes(freq) * 60_000_000, keep)
    return rows.groupBy("source").transformWithStateInPandas(processor, CLOCK_SCHEMA, "Update", "ProcessingTime")
