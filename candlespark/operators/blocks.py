"""Ordered computation over groups too large for one task.

A Spark window ``PARTITION BY symbol`` puts a symbol's whole history in one
task.  The helpers here cut each history into calendar cells and row blocks:

* ``row_index``   exact row number per group.  Only a table of counts per
  (group, cell) is ordered per group; rows are ordered within a cell.
* ``over_blocks`` exact row-frame windows.  Rows are numbered, cut into blocks
  of equal row count, and each block is given the ``before``/``after`` rows
  that its frames reach into; every task sees at most one block.
* ``carry_last``  newest earlier value (forward fill, as-of joins): rows are
  ordered within a cell, which starts from the last value of earlier cells.
* ``value_ranks`` average ranks by value ranges instead of one sort per group.

A cell holds at most ``cell_s / bar length`` bars, and a group has as many
cells as its calendar has, whatever the number of rows is.  Narrow cells cost
little (one small row each), so streams of ticks or events use minutes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from candlespark.functions.times import cell

MINUTE, HOUR, DAY = 60, 3_600, 86_400
MIN_BLOCK_ROWS = 4096


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _part(keys: Sequence[str]) -> list:
    return list(keys) if keys else [F.lit(0)]


def _by_cell(df: DataFrame, keys: Sequence[str], time: str, cell_s: int) -> DataFrame:
    """Rows with their cell, shuffled once by (keys, cell).

    Each helper below reads this shuffle twice: for the rows in order and for
    one row per cell.  Spark shares a shuffle between two branches only if both
    read the same columns under the same conditions.  So both look at whole
    rows, by their hash (the ordered branch as its last tie-break, which also
    makes the order total), and rows without a time are left out before the
    shuffle instead of by the join.  The input is then computed once, however
    long its lineage is; select the columns you need before calling.
    """
    rows = df.withColumn("_cell", cell(time, cell_s)).where(F.col("_cell").isNotNull())
    return rows.repartition(*keys, "_cell")


def _hash(rows: DataFrame) -> Column:
    return F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")])


def _whole(rows: DataFrame) -> Column:
    """An aggregate over all columns; never NULL for a group that has rows."""
    return F.max(_hash(rows)).alias("_whole")


def _per_cell(rows: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    on = [*keys, "_cell"]
    return rows.groupBy(*on).agg(*aggs, _whole(rows)).where(F.col("_whole").isNotNull()).drop("_whole")


def _cells_before(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*_part(keys)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    ties: Sequence[str] = (),
    cell_s: int = DAY,
    out: str = "row_idx",
    total: str | None = None,
) -> DataFrame:
    """Zero-based row number per group in (time, ties) order; ``total`` adds the group size."""
    on = [*keys, "_cell"]
    rows = _by_cell(df, keys, time, cell_s)
    counts = _per_cell(rows, keys, F.count(F.lit(1)).alias("_cell_n"))
    before = F.coalesce(F.sum("_cell_n").over(_cells_before(keys)), F.lit(0)).alias("_cell_before")
    size = [F.sum("_cell_n").over(Window.partitionBy(*_part(keys))).alias(total)] if total else []
    counts = counts.select(*on, before, *size)
    local = Window.partitionBy(*on).orderBy(*_cols([time, *ties]), _hash(rows))
    rows = rows.withColumn("_rn", F.row_number().over(local).cast("long"))
    extra = [F.col(total)] if total else []
    return rows.join(counts, on).select(*df.columns, (F.col("_cell_before") + F.col("_rn") - 1).alias(out), *extra)


def over_blocks(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    before: int,
    after: int,
    fn: Callable[[DataFrame, WindowSpec], DataFrame],
    ties: Sequence[str] = (),
    cell_s: int = DAY,
    block_rows: int | None = None,
) -> DataFrame:
    """Apply ``fn(rows, w)`` where ``w`` orders a block of a group by time.

    ``fn`` may use row frames over ``w`` that reach at most ``before`` rows
    back and ``after`` rows ahead (added up over chained windows).
    """
    size = F.lit(block_rows or max(MIN_BLOCK_ROWS, 8 * (before + after)))
    idx = row_index(df, keys, time, ties, cell_s, out="_idx")

    def block(i: Column) -> Column:
        return F.floor(i / size).cast("long")

    first = block(F.greatest(F.col("_idx") - after, F.lit(0)))
    last = block(F.col("_idx") + before)
    copies = idx.withColumn("_block", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "_block").orderBy("_idx")
    out = fn(copies, w).where(F.col("_block") == block(F.col("_idx")))
    return out.drop("_idx", "_block")


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    out: str,
    order: Sequence[str] = (),
    cell_s: int = DAY,
) -> DataFrame:
    """Newest non-null ``value`` at or before each row, in (time, order) order."""
    on = [*keys, "_cell"]
    rows = _by_cell(df, keys, time, cell_s)
    rank = F.struct(*_cols([time, *order])) if order else F.col(time)
    # The tail of a cell serves later cells until the next tail takes over.
    tails = _per_cell(rows, keys, F.max_by(value, F.when(F.col(value).isNotNull(), rank)).alias("_tail"))
    carried = tails.select(*on, F.last("_tail", ignorenulls=True).over(_cells_before(keys)).alias("_carry"))
    within = Window.partitionBy(*on).orderBy(*_cols([time, *order]), _hash(rows))
    local = F.last(value, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("_local", local)
        .join(carried, on)
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_cell", "_local", "_carry")
    )


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, ranges: int = 128, weight: str | None = None
) -> DataFrame:
    """(keys, value, n_equal, n_less, n_group) for each distinct value.

    Counts per distinct value are formed first, so ties never meet in one
    task; then the distinct values are ordered within approximate quantile
    ranges only.  The result is exact whatever the range bounds are.  ``df``
    may hold counted rows, with the count in ``weight``.
    """
    if not keys:
        return value_ranks(df.withColumn("_all", F.lit(0)), ["_all"], value, ranges, weight).drop("_all")
    count = F.sum(weight) if weight else F.count(F.lit(1))
    distinct = df.groupBy(*keys, value).agg(count.alias("n_equal"))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = distinct.groupBy(*keys).agg(
        F.percentile_approx(value, shares, 20 * ranges).alias("_bounds"), F.sum("n_equal").alias("n_group")
    )
    placed = distinct.join(bounds, list(keys)).withColumn(
        "_range", F.size(F.filter("_bounds", lambda b: b < F.col(value)))
    ).drop("_bounds")
    on = [*keys, "_range"]
    placed = placed.repartition(*on)
    span = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*on).agg(F.sum("n_equal").alias("_total"), _whole(placed)).where(F.col("_whole").isNotNull())
    offsets = totals.select(*on, F.coalesce(F.sum("_total").over(span), F.lit(0)).alias("_less"))
    local = Window.partitionBy(*on).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_in", F.coalesce(F.sum("n_equal").over(local), F.lit(0)))
        .join(offsets, on)
        .select(*keys, value, "n_equal", (F.col("_less") + F.col("_in")).alias("n_less"), "n_group")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], cell_s: int = DAY, ties: Sequence[str] = ()
) -> DataFrame:
    """Sum of each value up to and including the row in (time, ties) order, as ``<value>_sum``.

    Sums of earlier cells come from a table of sums per (keys, cell).
    """
    on = [*keys, "_cell"]
    rows = _by_cell(df, keys, time, cell_s)
    sums = _per_cell(rows, keys, *[F.sum(v).alias(f"_s_{v}") for v in values])
    span = _cells_before(keys)
    sums = sums.select(*on, *[F.coalesce(F.sum(f"_s_{v}").over(span), F.lit(0.0)).alias(f"_b_{v}") for v in values])
    local = Window.partitionBy(*on).orderBy(time, *ties, _hash(rows)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(v).over(local).alias(f"_l_{v}") for v in values]).join(sums, on)
    return rows.select(
        *df.columns, *[(F.col(f"_b_{v}") + F.coalesce(f"_l_{v}", F.lit(0.0))).alias(f"{v}_sum") for v in values]
    )
