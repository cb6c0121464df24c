"""As-of, interval and alignment joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.functions.times import MICRO, from_micros, micros
from candlespark.operators.blocks import HOUR, carry_last


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    lag_s: int = 0,
    tolerance_s: int | None = None,
    ties: Sequence[str] = (),
    cell_s: int = HOUR,
) -> DataFrame:
    """Join the newest right row at or before each left time, per key.

    Both sides are stacked and the newest right row is carried forward within
    calendar cells, so there is one shuffle by (key, cell), no range join, and
    a key's history is spread over its cells.  ``lag_s`` moves right times by
    a publication lag; matches older than ``tolerance_s`` are dropped.
    ``ties`` order right rows of one time.
    """
    ntz = dict(left.dtypes)[left_time] == "timestamp_ntz"
    lefts = left.select(
        *keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l")
    )
    moved = from_micros(micros(right_time) + lag_s * MICRO, ntz)
    fields = [F.col(right_time).alias("_rt"), *[F.col(v).alias(v) for v in values]]
    tie = F.struct(*ties) if ties else F.lit(0)
    rights = right.select(*keys, moved.alias("_t"), F.lit(0).alias("_side"), tie.alias("_tie"), F.struct(*fields).alias("_r"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    done = carry_last(both, keys, "_t", "_r", "_hit", order=["_side", "_tie"], cell_s=cell_s).where(F.col("_side") == 1)
    hit = F.col("_hit")
    if tolerance_s is not None:
        hit = F.when(micros("_t") - micros(F.col("_hit._rt")) <= tolerance_s * MICRO, hit)
    done = done.withColumn("_hit", hit)
    names = [F.col(f"_hit.{v}").alias(v) for v in values if v not in left.columns]
    return done.select("_l.*", F.col("_hit._rt").alias("matched_time"), *names)


def interval_join(
    points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, start: str, end: str, cell_s: int = HOUR
) -> DataFrame:
    """Points with the span ``[start, end)`` of the same key that holds them.

    Spans of a key do not overlap, so the newest span started by then is the
    only candidate: an as-of join, kept while the span is still open.
    """
    values = [c for c in spans.columns if c not in keys]
    out = asof_join(points, spans.withColumnRenamed(start, "_s").withColumn(start, F.col("_s")), keys, time, "_s", values, cell_s=cell_s)
    open_ = F.col(end).isNull() | (F.col(time) < F.col(end))
    return out.where(F.col(start).isNotNull() & open_).drop("matched_time")


def alignment(a: DataFrame, b: DataFrame, keys: Sequence[str], time: str, step_s: int) -> DataFrame:
    """Matched and unmatched rows of two sources when ``b`` is moved by -1, 0, +1 steps."""
    moves = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias("shift")
    left = a.select(*keys, F.col(time).alias("_t"), moves).withColumn("_a", F.lit(1))
    right = b.select(*keys, F.col(time), moves).withColumn("_b", F.lit(1))
    right = right.withColumn("_t", from_micros(micros(time) + F.col("shift").cast("long") * (step_s * MICRO))).drop(time)
    both = left.join(right, [*keys, "shift", "_t"], "full")
    hit_a, hit_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.groupBy(*keys, "shift").agg(
        F.count_if(hit_a & hit_b).alias("matched"),
        F.count_if(hit_a & ~hit_b).alias("only_a"),
        F.count_if(~hit_a & hit_b).alias("only_b"),
    )
