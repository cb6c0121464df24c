"""Mergeable quantile sketches of features, kept beside a model.

A sketch is a table of counts per (keys, feature, cell).  Cells follow the
logarithm of the value: any value of a cell is within ``accuracy`` of its
middle, relative to its size, whatever the distribution is.  Sketches of parts
merge by adding counts, so they are built with partial aggregation, extended by
later batches and compared with live data without reading training rows again.

A sketch has at most about 1,490 / log((1 + accuracy) / (1 - accuracy)) cells
(75,000 at 0.01) per (keys, feature) for any number of rows; a few hundred is
usual.  NULL and NaN go to the cell NULL, infinite values to the outermost cells.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlespark.functions.safe import div, ln

ACCURACY = 0.01
#: ln of the largest and, with its sign changed, of the smallest double.
LN_RANGE = 746.0


def _step(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy lies between 0 and 1")
    return math.log((1 + accuracy) / (1 - accuracy))


def cell_of(value: Column | str, accuracy: float = ACCURACY) -> Column:
    """Number of the value's cell; cells order as values do, 0 holds zeros only."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    step, middle = _step(accuracy), math.ceil(LN_RANGE / _step(accuracy)) + 1
    size = F.ceil(F.least(F.ln(F.abs(x)), F.lit(LN_RANGE)) / F.lit(step)) + middle
    return F.when(x == 0, F.lit(0)).when(F.isnan(x), None).when(x > 0, size).when(x < 0, -size).cast("long")


def cell_middle(cell: Column | str, accuracy: float = ACCURACY) -> Column:
    """The value that stands for a cell."""
    c = F.col(cell) if isinstance(cell, str) else cell
    step, middle = _step(accuracy), math.ceil(LN_RANGE / _step(accuracy)) + 1
    size = F.least(F.exp((F.abs(c) - middle) * F.lit(step) + F.lit(math.log(1 - accuracy))), F.lit(sys.float_info.max))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.signum(c.cast("double")) * size)


def sketch(df: DataFrame, keys: Sequence[str], features: Sequence[str], accuracy: float = ACCURACY) -> DataFrame:
    """(keys, feature, cell, n) of the named columns, in one pass."""
    items = F.array(*[F.struct(F.lit(f).alias("feature"), cell_of(f, accuracy).alias("cell")) for f in features])
    long = df.select(*keys, F.explode(items).alias("_i")).select(*keys, "_i.feature", "_i.cell")
    return long.groupBy(*keys, "feature", "cell").agg(F.count(F.lit(1)).alias("n"))


def merged(*sketches: DataFrame) -> DataFrame:
    """One sketch of all; the parts must have been made with the same accuracy."""
    both = sketches[0]
    for s in sketches[1:]:
        both = both.unionByName(s)
    return both.groupBy(*[c for c in both.columns if c != "n"]).agg(F.sum("n").alias("n"))


def store(made: DataFrame, path: str, model: str, accuracy: float = ACCURACY) -> None:
    """Keep the sketch of ``model`` below ``path``, in place of an earlier one of that model."""
    (
        made.withColumns({"accuracy": F.lit(accuracy), "model": F.lit(model)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model")
        .parquet(path)
    )


def stored(spark: SparkSession, path: str, model: str, accuracy: float = ACCURACY) -> DataFrame:
    """The sketch of one model; an error if it was made with another accuracy."""
    fit = F.abs(F.col("accuracy") - accuracy) < 1e-12
    made = spark.read.parquet(path).where(F.col("model") == model)
    return made.withColumn("n", F.when(fit, F.col("n")).otherwise(F.raise_error(F.lit("sketch of another accuracy")))).drop("model", "accuracy")


def quantiles(made: DataFrame, keys: Sequence[str], shares: Sequence[float], accuracy: float = ACCURACY) -> DataFrame:
    """(keys, feature, share, value): the cell of the row ranked ceil(share * n), at least the first.

    A group of missing values only has none.
    """
    on = [*keys, "feature"]
    known = made.where("cell IS NOT NULL")
    w = Window.partitionBy(*on).orderBy("cell")
    ranked = known.select(*on, "cell", F.sum("n").over(w).alias("_upto"), "n", F.sum("n").over(Window.partitionBy(*on)).alias("_all"))
    asked = ranked.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    rank = F.greatest(F.ceil(F.col("share") * F.col("_all")), F.lit(1))
    hit = asked.where((rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("n")))
    return hit.select(*on, "share", cell_middle("cell", accuracy).alias("value"))


def drift(train: DataFrame, live: DataFrame, keys: Sequence[str], per: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Live sketches against the training sketch, per (keys, feature) and live window ``per``.

    ``train`` has (keys, feature, cell, n), ``live`` the columns of ``per`` as
    well.  Bins hold equal shares of the training rows: a cell lies in bin
    floor(bins * training rows below it / training rows).  ``psi`` sums over the
    bins that have rows, with half a count added to each; ``ks`` is the largest
    distance of the two distributions at a cell's end; ``missing_shift`` the
    rise of the share of missing values.  Groups without training rows or
    without live rows are left out; groups with missing values only on one side
    have NULL psi and ks.
    """
    keys, per = list(keys), list(per)
    on, every = [*keys, "feature"], [*keys, *per, "feature"]
    windows = live.select(*every).distinct()
    sides = train.select(*on, "cell", F.col("n").alias("_o"), F.lit(0).cast("long").alias("_n")).join(windows, on)
    both = sides.unionByName(live.select(*every, "cell", F.lit(0).cast("long").alias("_o"), F.col("n").alias("_n")))
    cells = both.groupBy(*every, "cell").agg(F.sum("_o").alias("_o"), F.sum("_n").alias("_n"))
    group = Window.partitionBy(*every)
    upto = group.orderBy(F.col("cell").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("cell").isNotNull()

    def total(side: str) -> Column:
        return F.sum(F.when(known, F.col(side)).otherwise(0)).over(group)

    cells = cells.select(
        *every, "_o", "_n", known.alias("_known"), total("_o").alias("_to"), total("_n").alias("_tn"),
        F.sum("_o").over(upto).alias("_co"), F.sum("_n").over(upto).alias("_cn"),
    )
    below = F.col("_co") - F.col("_o")
    place = F.when(F.col("_known"), F.least(F.floor(div(below * bins, "_to")), F.lit(bins - 1)))
    gap = F.when(F.col("_known"), F.abs(div("_co", "_to") - div("_cn", "_tn")))
    per_bin = cells.groupBy(*every, place.alias("_b"), "_known", "_to", "_tn").agg(
        F.sum("_o").alias("_o"), F.sum("_n").alias("_n"), F.max(gap).alias("_gap")
    )
    n_bins = F.count_if("_known").over(group)
    so = div(F.col("_o") + 0.5, F.col("_to") + 0.5 * n_bins)
    sn = div(F.col("_n") + 0.5, F.col("_tn") + 0.5 * n_bins)
    held = F.col("_known") & (F.col("_to") > 0) & (F.col("_tn") > 0)
    parts = per_bin.select("*", F.when(held, (sn - so) * ln(sn / so)).alias("_p"))
    out = parts.groupBy(*every).agg(
        F.sum("_o").alias("n_train"), F.sum("_n").alias("n_live"), F.sum("_p").alias("psi"), F.max("_gap").alias("ks"),
        F.sum(F.when(~F.col("_known"), F.col("_o")).otherwise(0)).alias("_mo"),
        F.sum(F.when(~F.col("_known"), F.col("_n")).otherwise(0)).alias("_mn"),
    )
    shift = div("_mn", "n_live") - div("_mo", "n_train")
    return out.where("n_train > 0 AND n_live > 0").select(*every, "n_train", "n_live", "psi", "ks", shift.alias("missing_shift"))
