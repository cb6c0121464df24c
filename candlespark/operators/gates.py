"""Quality gates on evaluated predictions, drift and staleness checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.functions.safe import div, ln
from candlespark.functions.times import MICRO, micros
from candlespark.operators.blocks import DAY, over_blocks, value_ranks

KEYS = ("symbol",)


def gates(reports: DataFrame, limits: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Independent thresholds; ``all_pass`` only when every one holds.

    ``limits`` maps a metric to ("min" | "max", bound); a NULL metric fails.
    """
    flags = []
    for metric, (side, bound) in limits.items():
        ok = F.col(metric) >= bound if side == "min" else F.col(metric) <= bound
        flags.append((f"{metric}_ok", F.coalesce(ok, F.lit(False))))
    out = reports.select("*", *[c.alias(n) for n, c in flags])
    every = F.lit(True)
    for n, _ in flags:
        every = every & F.col(n)
    return out.withColumn("all_pass", every)


def hit_rate(y: str = "y_true", p: str = "y_pred") -> Column:
    moved = F.col(y) != 0
    return div(F.count_if(moved & (F.signum(y) == F.signum(p))), F.count_if(moved))


def stability(pairs: DataFrame, keys: Sequence[str], period: Column, threshold: float) -> DataFrame:
    """Hit rate per sub-period; the worst one must reach ``threshold``."""
    per = pairs.groupBy(*keys, period.alias("period")).agg(hit_rate().alias("da"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(
        F.min("da").alias("worst_da"), F.max("da").alias("best_da"), F.count(F.lit(1)).alias("n_periods"),
        (F.min("da") >= threshold).alias("stable"),
    )


def regimes(pairs: DataFrame, keys: Sequence[str], time: str = "open_time", k: int = 24, cell_s: int = DAY) -> DataFrame:
    """Label rows low / mid / high by terciles of trailing volatility per key.

    The volatility of a row uses earlier outcomes only.
    """
    keys = list(keys)

    def columns(d, w):
        past = w.rowsBetween(-k, -1)
        full = F.count("y_true").over(past) == k
        return d.withColumn("trailing_vol", F.when(full, F.stddev_samp("y_true").over(past)))

    d = over_blocks(pairs, keys, time, k, 0, columns, cell_s=cell_s).where("trailing_vol IS NOT NULL")
    ranks = value_ranks(d, keys, "trailing_vol")
    third = F.floor(3 * F.col("n_less") / F.col("n_group")).cast("int")
    label = F.when(third == 0, "low").when(third == 1, "mid").otherwise("high").alias("regime")
    return d.join(ranks.select(*keys, "trailing_vol", label), [*keys, "trailing_vol"])


def regime_gate(labelled: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    out = labelled.groupBy(*keys, "regime").agg(hit_rate().alias("da"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("ok", F.coalesce(F.col("da") >= threshold, F.lit(False)))


def rolling_accuracy(pairs: DataFrame, keys: Sequence[str], k: int, threshold: float, time: str = "open_time", cell_s: int = DAY) -> DataFrame:
    """Hit rate of the last ``k`` rows; ``trigger`` where it falls below the gate."""

    def columns(d, w):
        f = w.rowsBetween(-(k - 1), 0)
        hit = F.when(F.col("y_true") != 0, (F.signum("y_true") == F.signum("y_pred")).cast("double"))
        full = F.count(F.lit(1)).over(f) == k
        return d.withColumn("rolling_da", F.when(full, F.avg(hit).over(f)))

    out = over_blocks(pairs, keys, time, k - 1, 0, columns, cell_s=cell_s)
    return out.withColumn("trigger", F.coalesce(F.col("rolling_da") < threshold, F.lit(False)))


def drift(train: DataFrame, live: DataFrame, feature: str, keys: Sequence[str], bins: int = 10, lo: float = -5.0, hi: float = 5.0) -> DataFrame:
    """Population stability index over equal-width bins, and the mean shift.

    Values beyond the range fall into the outer bins; shares get half a count
    so that empty bins stay finite.
    """
    keys = list(keys)
    width = (hi - lo) / bins
    b = F.least(F.greatest(F.floor((F.col(feature) - lo) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    both = train.select(*keys, F.lit(0).alias("_live"), F.col(feature)).unionByName(
        live.select(*keys, F.lit(1).alias("_live"), F.col(feature))
    ).where(F.col(feature).isNotNull())
    old, new = F.col("_live") == 0, F.col("_live") == 1
    # One pass of counts per (key, bin); the rest works on that small table.
    counts = both.groupBy(*keys, b.alias("_b")).agg(
        F.count_if(old).alias("_o"), F.count_if(new).alias("_n"),
    )
    per_key = Window.partitionBy(*keys)
    so = (F.col("_o") + 0.5) / (F.sum("_o").over(per_key) + 0.5 * bins)
    sn = (F.col("_n") + 0.5) / (F.sum("_n").over(per_key) + 0.5 * bins)
    parts = counts.select(*keys, "_o", "_n", ((sn - so) * ln(sn / so)).alias("_p"))
    # Bins empty on both sides are not listed; they add the same small share twice.
    totals = parts.groupBy(*keys).agg(
        F.sum("_p").alias("_psi"), F.count(F.lit(1)).alias("_k"), F.sum("_o").alias("n_train"), F.sum("_n").alias("n_live")
    )
    eo, en = div(F.lit(0.5), F.col("n_train") + 0.5 * bins), div(F.lit(0.5), F.col("n_live") + 0.5 * bins)
    psi = F.col("_psi") + (bins - F.col("_k")) * (en - eo) * ln(en / eo)
    moments = both.groupBy(*keys).agg(
        F.avg(F.when(old, F.col(feature))).alias("_mo"), F.avg(F.when(new, F.col(feature))).alias("_mn"),
        F.stddev_samp(F.when(old, F.col(feature))).alias("_so"), F.stddev_samp(F.when(new, F.col(feature))).alias("_sn"),
    )
    return totals.join(moments, keys).select(
        *keys, "n_train", "n_live", psi.alias("psi"),
        div(F.col("_mn") - F.col("_mo"), "_so").alias("mean_shift"), div("_sn", "_so").alias("std_ratio"),
    )


def staleness(models: DataFrame, as_of: Column, max_age_s: int, trained: str = "trained_at") -> DataFrame:
    age = (micros(as_of) - micros(trained)) / F.lit(float(DAY * MICRO))
    return models.withColumn("age_days", age).withColumn("stale", age > max_age_s / DAY)


def combine(parts: DataFrame, keys: Sequence[str], how: str = "mean", value: str = "y_pred", weight: str | None = None) -> DataFrame:
    """Join sub-predictions of a decomposed target: sum, product or weighted mean.

    Infinite and NaN parts count as in floating point: a product of zero and an infinite part is NaN.
    """
    v = F.col(value)
    made = {
        "sum": lambda: F.sum(v),
        "mean": lambda: div(F.sum(v * F.col(weight)), F.sum(weight)) if weight else F.avg(v),
        "product": lambda: F.product(v),
    }
    return parts.groupBy(*keys).agg(made[how]().alias(value))
