"""Prediction metrics per group, in one job for all groups.

``evaluate`` forms partial results per (group, calendar cell), including the
part of the lag-1 statistics inside the cell, and joins the cells at their
edges; no group is ever ordered as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.functions.safe import div, normal_cdf, root
from candlespark.functions.tails import binomial_tail, corr_pvalue
from candlespark.functions.times import cell
from candlespark.operators.blocks import DAY, over_blocks, value_ranks

# Thresholds, grades by number of passes, year length, 95 % quantile.
THRESHOLDS = {
    "directional_accuracy": 0.52,
    "da_ci_lower": 0.50,
    "da_pvalue": 0.05,
    "pearson_r": 0.05,
    "pearson_pvalue": 0.05,
    "wrmse_improvement": 0.05,
    "czar_improvement": 0.10,
}
GRADES = {7: "A+", 6: "A", 5: "B+", 4: "B", 3: "C", 2: "D", 1: "F", 0: "F"}
COVERAGE = 0.50
MINUTES_PER_YEAR = 365.24 * 24 * 60
Z95 = 1.96

def _yp() -> tuple[Column, Column]:
    return F.col("y_true"), F.col("y_pred")


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Correlation aggregate; NULL when either side is constant."""
    return div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _cells(pairs: DataFrame, keys: Sequence[str], time: str, cell_s: int, pool: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Partial results per (keys, cell), with the last hit of earlier cells.

    A pooled series is ordered by ``pool`` and then time; rows of one time by ``ties``.
    """
    Y, P = _yp()
    on = [*keys, *pool, "_cell"]
    moved = Y != 0
    same = F.signum(Y) == F.signum(P)
    hit = F.when(moved, same.cast("long"))
    past = Window.partitionBy(*on).orderBy(time, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = pairs.withColumn("_cell", cell(time, cell_s)).withColumn("_hit", hit)
    rows = rows.withColumn("_last", F.last("_hit", ignorenulls=True).over(past))
    err, size = Y - P, F.abs(Y)
    # Time alone stays in the hash aggregate; a struct would sort the rows.
    at = F.when(moved, F.struct(*pool, time, *ties) if pool or ties else F.col(time))
    up, call = Y > 0, P > 0
    out = rows.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_hit").alias("n_moved"),
        F.coalesce(F.sum("_hit"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.col("_last") * F.col("_hit")), F.lit(0)).alias("hit_pairs"),
        F.min_by("_hit", at).alias("first_hit"),
        F.max_by("_hit", at).alias("last_hit"),
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
        F.avg(Y).alias("my"), F.avg(P).alias("mp"),
        F.var_pop(Y).alias("vy"), F.var_pop(P).alias("vp"), F.covar_pop(Y, P).alias("cyp"),
        F.sum(size).alias("w"),
        F.sum(size * err * err).alias("w_se"),
        F.sum(size * Y * Y).alias("w_yy"),
        F.sum(F.when(same, size).otherwise(-size)).alias("signed"),
        F.sum(F.abs(err)).alias("abs_err"),
        F.sum(err * err).alias("sq_err"),
        F.coalesce(F.sum(F.when(moved, F.abs(div(err, Y)))), F.lit(0.0)).alias("rel_err"),
        F.count_if(up & call).alias("tp"), F.count_if(~up & ~call).alias("tn"),
        F.count_if(~up & call).alias("fp"), F.count_if(up & ~call).alias("fn"),
    )
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*pool, "_cell").rowsBetween(Window.unboundedPreceding, -1)
    edge = F.last("last_hit", ignorenulls=True).over(before)
    return out.withColumn("edge_pair", F.coalesce(edge * F.col("first_hit"), F.lit(0)))


def _merge(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the partial results of a group's cells."""
    n, add = F.sum("n"), lambda c: F.sum(c).alias(c)
    my, mp = F.sum(F.col("n") * F.col("my")) / n, F.sum(F.col("n") * F.col("mp")) / n

    def spread(v: str, a: str, b: str, ma: Column, mb: Column) -> Column:
        within = F.sum(F.col("n") * F.col(v)) / n
        return within + F.sum(F.col("n") * F.col(a) * F.col(b)) / n - ma * mb

    return cells.groupBy(*keys).agg(
        n.alias("n_samples"), add("n_moved"), add("hits"),
        (F.sum("hit_pairs") + F.sum("edge_pair")).alias("hit_pairs"),
        F.min_by("first_hit", "first_at").alias("first_hit"),
        F.max_by("last_hit", "last_at").alias("last_hit"),
        my.alias("mean_true"),
        spread("vy", "my", "my", my, my).alias("_vy"),
        spread("vp", "mp", "mp", mp, mp).alias("_vp"),
        spread("cyp", "my", "mp", my, mp).alias("_cyp"),
        *[add(c) for c in ("w", "w_se", "w_yy", "signed", "abs_err", "sq_err", "rel_err", "tp", "tn", "fp", "fn")],
        F.count_if(F.col("vy") != 0).alias("_ragged_y"), F.count_if(F.col("vp") != 0).alias("_ragged_p"),
        (F.max("my") - F.min("my")).alias("_gap_y"), (F.max("mp") - F.min("mp")).alias("_gap_p"),
    )


def _directional(d: DataFrame) -> DataFrame:
    n, hits = F.col("n_moved"), F.col("hits")
    m = n - 1
    # Pairs (previous, next) of 0/1 hits: sums without the last and without the first.
    sx, sy = hits - F.col("last_hit"), hits - F.col("first_hit")
    over = (m * F.col("hit_pairs") - sx * sy).cast("double")
    under = root(((m * sx - sx * sx) * (m * sy - sy * sy)).cast("double"))
    rho = F.when(n > 2, F.greatest(F.coalesce(div(over, under), F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))
    d = d.withColumns({"da_autocorrelation": rho, "directional_accuracy": F.coalesce(div(hits, n), F.lit(0.5))})
    rho, da = F.col("da_autocorrelation"), F.col("directional_accuracy")
    thin = n.cast("double") * (1 - rho) / (1 + rho)
    d = d.withColumn("da_n_effective", F.when(n > 2, F.greatest(thin, F.lit(2.0))).otherwise(n.cast("double")))
    ne = F.col("da_n_effective")
    z = F.greatest(div(da - 0.5 - div(0.5, ne), F.sqrt(div(0.25, ne))), F.lit(0.0))
    zz = Z95 * Z95
    denom = 1 + div(zz, ne)
    center = div(da + div(zz, 2 * ne), denom)
    margin = div(Z95 * F.sqrt(div(da * (1 - da), ne) + div(zz, 4 * ne * ne)), denom)
    some = n > 0
    return d.withColumns(
        {
            "da_pvalue": F.when(some, 1 - normal_cdf(z)).otherwise(1.0),
            "da_ci_lower": F.when(some, center - margin).otherwise(0.0),
            "da_ci_upper": F.when(some, center + margin).otherwise(1.0),
        }
    ).withColumnsRenamed({"n_moved": "da_n_samples", "hits": "da_n_correct"})


def _moments(d: DataFrame) -> DataFrame:
    """Standard deviations and correlation; exactly 0 for a constant side."""
    zero = F.lit(0.0)
    flat_y = (F.col("_ragged_y") == 0) & (F.col("_gap_y") == 0)
    flat_p = (F.col("_ragged_p") == 0) & (F.col("_gap_p") == 0)
    d = d.withColumns(
        {"std_true": F.when(flat_y, zero).otherwise(root("_vy")), "std_pred": F.when(flat_p, zero).otherwise(root("_vp"))}
    )
    r = div("_cyp", F.col("std_true") * F.col("std_pred"))
    return d.withColumn("pearson_r", F.greatest(F.least(F.coalesce(r, zero), F.lit(1.0)), F.lit(-1.0)))


def evaluate(
    pairs: DataFrame,
    keys: Sequence[str] = (),
    time: str = "open_time",
    epoch_minutes: int = 60,
    n_expected: int | None = None,
    cell_s: int = DAY,
    pool: Sequence[str] = (),
    ties: Sequence[str] = (),
) -> DataFrame:
    """One row per group: all metrics, pass flags, score and grade.

    ``pairs`` holds (keys, time, y_true, y_pred).  ``pool`` names columns whose
    series are graded as one, each after the other; without it, rows of one
    time are ordered by ``ties``, which must then tell them apart.
    """
    keys = list(keys)
    d = _moments(_directional(_merge(_cells(pairs, keys, time, cell_s, pool, ties), keys)))
    zero, one, n = F.lit(0.0), F.lit(1.0), F.col("n_samples")
    varied = F.col("std_true") > 0
    defined = varied & (F.col("std_pred") > 0)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    total = n * F.col("std_true") * F.col("std_true")
    d = d.withColumns(
        {
            "pearson_pvalue": F.when(defined, corr_pvalue("pearson_r", "n_samples")).otherwise(one),
            "wrmse_model": F.coalesce(F.sqrt(div("w_se", "w")), zero),
            "wrmse_baseline": F.coalesce(F.sqrt(div("w_yy", "w")), zero),
            "czar_model": F.when(varied, div("signed", "std_true")).otherwise(zero),
            "czar_oracle": F.when(varied, div("w", "std_true")).otherwise(zero),
            "log_aspect_ratio": F.when(defined, F.log10(div("std_pred", "std_true"))).otherwise(zero),
            "naive_return": F.col("signed"),
            "naive_annualized_return": F.col("signed") * (MINUTES_PER_YEAR / epoch_minutes) / n,
            "mae": F.col("abs_err") / n,
            "mse": F.col("sq_err") / n,
            "r2": F.when(total > 0, 1 - div("sq_err", total)).otherwise(zero),
            "mape": F.coalesce(div("rel_err", "da_n_samples") * 100, F.lit(float("inf"))),
            "precision": F.coalesce(div(tp, tp + fp), zero),
            "recall": F.coalesce(div(tp, tp + fn), zero),
            "specificity": F.coalesce(div(tn, tn + fp), zero),
        }
    )
    model, base = F.col("wrmse_model"), F.col("wrmse_baseline")
    pr, rc = F.col("precision"), F.col("recall")
    d = d.withColumns(
        {
            "wrmse_improvement": F.coalesce(div(base - model, base), zero),
            "czar_improvement": F.coalesce(div("czar_model", "czar_oracle"), zero),
            "rmse": F.sqrt("mse"),
            "f1_score": F.coalesce(div(2 * pr * rc, pr + rc), zero),
        }
    ).withColumnsRenamed(
        {"tp": "true_positives", "tn": "true_negatives", "fp": "false_positives", "fn": "false_negatives"}
    )
    if n_expected is not None:
        d = d.withColumn("temporal_coverage_pass", coverage(n, F.lit(n_expected)))
    hidden = [c for c in d.columns if c.startswith("_")]
    parts = ["hit_pairs", "first_hit", "last_hit", "mean_true", "w", "w_se", "w_yy", "signed", "abs_err", "sq_err", "rel_err"]
    return grade(d.drop(*hidden, *parts))


def coverage(n: Column, expected: Column, threshold: float = COVERAGE) -> Column:
    return (expected > 0) & F.coalesce(div(n, expected) >= threshold, F.lit(False))


def grade(report: DataFrame) -> DataFrame:
    """Seven pass flags, the share passed and the letter."""
    t = THRESHOLDS
    flags = {
        "da_pass": F.col("directional_accuracy") >= t["directional_accuracy"],
        "da_ci_pass": F.col("da_ci_lower") >= t["da_ci_lower"],
        "da_pvalue_pass": F.col("da_pvalue") < t["da_pvalue"],
        "pearson_r_pass": F.col("pearson_r") >= t["pearson_r"],
        "pearson_pvalue_pass": F.col("pearson_pvalue") < t["pearson_pvalue"],
        "wrmse_improvement_pass": F.col("wrmse_improvement") >= t["wrmse_improvement"],
        "czar_improvement_pass": F.col("czar_improvement") >= t["czar_improvement"],
    }
    out = report.select("*", *[c.alias(k) for k, c in flags.items()])
    passed = sum((F.col(k).cast("long") for k in flags), F.lit(0).cast("long"))
    letters = F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv])
    won = F.col("num_passed")
    out = out.withColumn("num_passed", passed)
    return out.withColumns({"score": won / F.lit(7.0), "grade": F.element_at(letters, won.cast("int"))})


def zptae(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """|y|-weighted error of power-tanh z-scores against predicting 0.

    Needs the group deviation first: a small aggregate, joined back.
    """
    Y, P = _yp()
    keys = list(keys)
    std = pairs.groupBy(*keys).agg(F.stddev_pop(Y).alias("_std"))

    def squash(x: Column) -> Column:
        return F.tanh(F.pow(F.abs(x), F.lit(3.0))) * F.signum(x)

    zt = squash(div(Y, "_std"))
    zp = squash(div(P, "_std"))
    w = F.abs(Y)
    d = pairs.join(std, keys).groupBy(*keys).agg(
        div(F.sum(w * F.abs(zt - zp)), F.sum(w)).alias("_m"), div(F.sum(w * F.abs(zt)), F.sum(w)).alias("_b")
    )
    m, b = F.coalesce("_m", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    return d.select(
        *keys, m.alias("zptae_model"), b.alias("zptae_baseline"),
        F.coalesce(div(b - m, b), F.lit(0.0)).alias("zptae_improvement"),
    )


def spearman(pairs: DataFrame, keys: Sequence[str], ranges: int = 128) -> DataFrame:
    """Rank correlation with average ranks; p from the same t test."""
    keys = list(keys)
    # Everything below starts from the counted pairs: one pass over the input.
    combos = pairs.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("_w"))
    c = combos
    for side in ("y_true", "y_pred"):
        ranks = value_ranks(combos, keys, side, ranges, weight="_w")
        # Average ranks have the known mean (N + 1) / 2; centred, the sums stay small.
        off = F.col("n_less") + F.col("n_equal") / 2.0 - F.col("n_group") / 2.0
        c = c.join(ranks.select(*keys, side, off.alias(f"_d_{side}")), [*keys, side])
    da, db, n = F.col("_d_y_true"), F.col("_d_y_pred"), F.col("_w")
    out = c.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        div(F.sum(n * da * db), F.sqrt(F.sum(n * da * da) * F.sum(n * db * db))).alias("_r"),
    )
    r = F.greatest(F.least(F.coalesce("_r", F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))
    p = F.when(F.col("_r").isNull(), F.lit(1.0)).otherwise(corr_pvalue("spearman_r", "n"))
    return out.withColumn("spearman_r", r).withColumn("spearman_pvalue", p).drop("_r")


def evaluate_complete(pairs: DataFrame, keys: Sequence[str] = (), time: str = "open_time", **options) -> DataFrame:
    """``evaluate`` with the rank correlation and the ZPTAE errors in the same row.

    Flags, score and grade are those of ``evaluate``.  Rows with a NULL key are left out.
    """
    on = list(keys) or ["all_pairs"]
    rows = pairs if keys else pairs.withColumn("all_pairs", F.lit(0))
    report = evaluate(rows, on, time, **options).join(spearman(rows, on).drop("n"), on).join(zptae(rows, on), on)
    return report if keys else report.drop("all_pairs")


def long_report(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, section, metric, value, pass): the report as rows."""
    flag = {
        "directional_accuracy": "da_pass", "da_ci_lower": "da_ci_pass", "da_pvalue": "da_pvalue_pass",
        "pearson_r": "pearson_r_pass", "pearson_pvalue": "pearson_pvalue_pass",
        "wrmse_improvement": "wrmse_improvement_pass", "czar_improvement": "czar_improvement_pass",
    }
    numeric = [c for c, t in report.dtypes if c not in keys and t in ("double", "bigint") and c not in ("num_passed", "score")]
    items = [
        F.struct(
            F.lit("primary" if c in flag else "additional").alias("section"), F.lit(c).alias("metric"),
            F.col(c).cast("double").alias("value"),
            (F.col(flag[c]) if c in flag else F.lit(None).cast("boolean")).alias("passed"),
        )
        for c in numeric
    ]
    return report.select(*keys, F.explode(F.array(*items)).alias("m")).select(*keys, "m.*")


def binomial_test(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-sided tests of the hits against 1/2 and against the larger base rate."""
    Y, P = _yp()
    moved = Y != 0
    d = pairs.groupBy(*keys).agg(
        F.count_if(moved).alias("n"),
        F.count_if(moved & (F.signum(Y) == F.signum(P))).alias("hits"),
        F.count_if(Y > 0).alias("_up"),
    )
    up = div("_up", "n")
    d = d.withColumn("base_rate", F.greatest(up, 1 - up)).drop("_up")
    d = d.withColumn("p_half", binomial_tail("hits", "n", F.lit(0.5)))
    return d.withColumn("p_base", binomial_tail("hits", "n", "base_rate"))


def calibration(pairs: DataFrame, keys: Sequence[str], n_bins: int = 5) -> DataFrame:
    """Mean outcome size by bins of prediction size, and whether it rises.

    Equal sizes share a bin: bin = floor(n_bins * rows below / rows).
    """
    Y, P = _yp()
    keys = list(keys)
    sized = pairs.select(*keys, F.abs(Y).alias("size_true"), F.abs(P).alias("size_pred"))
    per_value = sized.groupBy(*keys, "size_pred").agg(F.sum("size_true").alias("_s"), F.count(F.lit(1)).alias("_n"))
    ranks = value_ranks(per_value, keys, "size_pred", weight="_n")
    placed = per_value.join(ranks, [*keys, "size_pred"])
    bins = placed.withColumn("bin", F.floor(n_bins * F.col("n_less") / F.col("n_group")).cast("int"))
    out = bins.groupBy(*keys, "bin").agg(
        F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_n")).alias("mean_size"),
        (F.sum(F.col("_n") * F.col("size_pred")) / F.sum("_n")).alias("mean_pred_size"),
    )
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("bin")
    return out.withColumn("rises", F.col("mean_size") > F.lag("mean_size").over(w))


def baselines(pairs: DataFrame, keys: Sequence[str], time: str, k: int = 24, cell_s: int = DAY) -> DataFrame:
    """Long form (keys, baseline, time, y_true, y_pred) of simple predictors.

    A row's outcome is known one row later, so each uses earlier rows only:
    zero, persistence, the mean of the last ``k`` and the mean of all earlier.
    """
    Y, P = _yp()
    from candlespark.operators.blocks import running_sum

    keys = list(keys)

    def columns(d, w):
        return d.withColumn("persistence", F.lag("y_true").over(w)).withColumn(
            "sma", F.avg("y_true").over(w.rowsBetween(-k, -1))
        )

    d = over_blocks(pairs.select(*keys, time, "y_true"), keys, time, k, 0, columns, cell_s=cell_s)
    d = running_sum(d.withColumn("_one", F.lit(1.0)), keys, time, ["y_true", "_one"], cell_s=cell_s)
    mean = div(F.col("y_true_sum") - Y, F.col("_one_sum") - 1)
    made = {"zero": F.lit(0.0), "persistence": F.col("persistence"), "sma": F.col("sma"), "mean": mean}
    items = F.array(*[F.struct(F.lit(k).alias("baseline"), c.alias("y_pred")) for k, c in made.items()])
    out = d.select(*keys, time, "y_true", F.explode(items).alias("b"))
    return out.select(*keys, "b.baseline", time, "y_true", "b.y_pred").where("y_pred IS NOT NULL")


def financial(pairs: DataFrame, keys: Sequence[str], epoch_minutes: int = 60) -> DataFrame:
    """Information coefficient, annualised Sharpe ratio and profit factor."""
    Y, P = _yp()
    gain = F.signum(P) * Y
    scale = (MINUTES_PER_YEAR / epoch_minutes) ** 0.5
    return pairs.groupBy(*keys).agg(
        F.coalesce(safe_corr(Y, P), F.lit(0.0)).alias("information_coefficient"),
        (div(F.avg(gain), F.stddev_pop(gain)) * scale).alias("sharpe"),
        div(F.sum(F.greatest(gain, F.lit(0.0))), F.sum(F.greatest(-gain, F.lit(0.0)))).alias("profit_factor"),
    )


# Poisson(1) distribution function at 0, 1, 2, ... as far as a draw of 32 bits can tell it from 1.
POISSON_1 = [
    f for f in accumulate(math.exp(-1) / math.factorial(k) for k in range(20)) if f <= 1 - 2.0**-32
]


def bootstrap_accuracy(
    pairs: DataFrame, keys: Sequence[str], time: str, replicates: int = 200, block_s: int = DAY, seed: int = 7
) -> DataFrame:
    """Percentile interval of the hit rate from a block bootstrap.

    Hits are summed per time block first; a replicate then weights whole
    blocks with Poisson(1) counts drawn from a hash of (seed, keys, block,
    replicate), so reruns and lost executors give the same draws.
    """
    Y, P = _yp()
    keys = list(keys)
    moved = Y != 0
    blocks = pairs.groupBy(*keys, cell(time, block_s).alias("_b")).agg(
        F.count_if(moved).alias("_n"), F.count_if(moved & (F.signum(Y) == F.signum(P))).alias("_h")
    )
    draws = blocks.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    text = F.concat_ws("|", F.lit(str(seed)), *keys, F.col("_b").cast("string"), F.col("_rep").cast("string"))
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    weight = sum(((u >= p).cast("long") for p in POISSON_1), F.lit(0).cast("long"))
    rates = draws.withColumn("_w", weight).groupBy(*keys, "_rep").agg(
        div(F.sum(F.col("_w") * F.col("_h")), F.sum(F.col("_w") * F.col("_n"))).alias("_da")
    )
    return rates.groupBy(*keys).agg(
        F.count("_da").alias("replicates"), F.avg("_da").alias("da_mean"),
        F.percentile("_da", 0.025).alias("da_low"), F.percentile("_da", 0.975).alias("da_high"),
    )


def adjust_pvalues(tests: DataFrame, p: str, tie: Sequence[str], family: Sequence[str] = ()) -> DataFrame:
    """Bonferroni and Holm p-values over the variants of a family.

    The table has one row per variant tried, not per observation.
    """
    part = Window.partitionBy(*(family or [F.lit(0)]))
    w = part.orderBy(p, *tie)
    m = F.count(F.lit(1)).over(part)
    d = tests.withColumn("n_variants", m).withColumn("_k", F.row_number().over(w))
    d = d.withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * F.col("n_variants")))
    step = F.least(F.lit(1.0), F.col(p) * (F.col("n_variants") - F.col("_k") + 1))
    d = d.withColumn("_step", step)
    holm = F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("holm", holm).drop("_k", "_step")
