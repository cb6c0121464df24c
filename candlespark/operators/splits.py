"""Time-ordered splits: library folds, purged walk-forward, three stages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespark.functions.safe import div
from candlespark.functions.times import MICRO, from_micros, is_ntz, micros
from candlespark.operators.blocks import DAY, row_index, running_sum

KEYS = ("symbol",)


def time_series_split(
    df: DataFrame, n_splits: int, gap: int = 0, max_train: int | None = None,
    keys: Sequence[str] = KEYS, time: str = "open_time", ties: Sequence[str] = (), cell_s: int = DAY,
) -> DataFrame:
    """Rows with (fold, role) of the usual expanding time-series split.

    The last ``n_splits`` blocks of n // (n_splits + 1) rows are the tests;
    training ends ``gap`` rows before each.  Rows are numbered by
    :func:`row_index`, so no history is ordered in one task.
    """
    idx = row_index(df, keys, time, ties, cell_s, out="_i", total="_n")
    size = F.floor(F.col("_n") / (n_splits + 1)).cast("long")
    fold = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold")
    rows = idx.withColumn("_size", size).select("*", fold)
    start = F.col("_n") - (n_splits - F.col("fold")) * F.col("_size")
    i, last = F.col("_i"), start - gap
    train = i < last
    if max_train is not None:
        train = train & (i >= last - max_train)
    test = (i >= start) & (i < start + F.col("_size"))
    role = F.when(train, "train").when(test, "test")
    return rows.withColumn("role", role).where(F.col("role").isNotNull()).drop("_i", "_n", "_size")


def purge_gap(horizon: int, windows: Sequence[int], margin: int = 0) -> int:
    """Rows between train and test: nothing on one side may see the other."""
    return max(horizon, *windows) + margin


def fold_table(
    n_rows: int, test_size: int, n_folds: int, gap: int, val_size: int | None = None, train_size: int | None = None
) -> list[tuple[int, int, int, int, int, int, int]]:
    """(fold, train_lo, train_hi, val_lo, val_hi, test_lo, test_hi), ends open.

    Tests are the last blocks of the range.  Validation is the tail of
    training, by default as long as the test; ``train_size`` makes it slide.
    """
    val = test_size if val_size is None else val_size
    out = []
    for f in range(n_folds):
        test_lo = n_rows - (n_folds - f) * test_size
        val_hi = test_lo - gap
        val_lo = val_hi - val
        train_hi = val_lo - gap
        train_lo = 0 if train_size is None else max(0, train_hi - train_size)
        if train_hi <= train_lo:
            raise ValueError("history too short for these folds")
        out.append((f, train_lo, train_hi, val_lo, val_hi, test_lo, test_lo + test_size))
    return out


def folds_for_budget(n_test_rows: int, test_size: int) -> int:
    """Windows that keep the total tested span at a constant number of rows."""
    return max(1, n_test_rows // test_size)


def coverage_plan(df: DataFrame, test_share: float, sizes: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, test_size, n_rows, n_test_rows, n_folds, n_covered): folds of each size that test the same span.

    The last ``test_share`` of a group's rows is tested by
    ``folds_for_budget`` windows; ``n_covered`` is the number of rows in them.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    budget = F.floor(F.col("n_rows") * F.lit(test_share)).cast("long")
    d = n.withColumn("n_test_rows", budget).withColumn("test_size", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes])))
    d = d.withColumn("n_folds", F.greatest(F.lit(1).cast("long"), F.floor(F.col("n_test_rows") / F.col("test_size")).cast("long")))
    return d.withColumn("n_covered", F.least(F.col("n_folds") * F.col("test_size"), F.col("n_rows")))


def walk_forward(
    df: DataFrame, test_share: float, n_folds: int, gap: int, keys: Sequence[str] = KEYS,
    train_rows: int | None = None, time: str = "open_time", cell_s: int = DAY,
) -> DataFrame:
    """Purged walk-forward per group: each row with (fold, role) of train, validation, test.

    Fold bounds follow each group's own row count; the gap rows between the
    parts belong to no role.
    """
    idx = row_index(df, keys, time, (), cell_s, out="_i", total="_n")
    rows = idx.withColumn("_t", F.floor(F.col("_n") * test_share).cast("long")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold")
    )
    test_lo = F.col("_n") - (n_folds - F.col("fold")) * F.col("_t")
    val_hi = test_lo - gap
    val_lo = val_hi - F.col("_t")
    train_hi = val_lo - gap
    train_lo = F.lit(0) if train_rows is None else F.greatest(F.lit(0), train_hi - train_rows)
    i = F.col("_i")
    role = (
        F.when((i >= train_lo) & (i < train_hi), "train")
        .when((i >= val_lo) & (i < val_hi), "validation")
        .when((i >= test_lo) & (i < test_lo + F.col("_t")), "test")
    )
    return rows.withColumn("role", role).where(F.col("role").isNotNull()).drop("_i", "_n", "_t")


def stage_bounds(df: DataFrame, stage_s: int, time: str = "open_time"):
    """Starts of evaluation and deployment when both take ``stage_s`` seconds and deployment ends with the data."""
    newest = df.agg(F.max(time).alias("t")).first()["t"]
    if newest is None:
        return None, None
    end = newest + timedelta(microseconds=1)
    return end - timedelta(seconds=2 * stage_s), end - timedelta(seconds=stage_s)


def three_stage(df: DataFrame, evaluation_start, deployment_start, gap_s: int, time: str = "open_time") -> DataFrame:
    """Label rows inner / evaluation / deployment with a gap before each of the last two.

    Deployment runs to the newest row; evaluation should be as long, its gap included.
    """
    e, d = (F.lit(x).cast("timestamp_ntz") for x in (evaluation_start, deployment_start))
    gap = gap_s * MICRO
    us = micros(time)
    stage = (
        F.when(us < micros(e) - gap, "inner")
        .when((us >= micros(e)) & (us < micros(d) - gap), "evaluation")
        .when(us >= micros(d), "deployment")
    )
    return df.withColumn("stage", stage).where(F.col("stage").isNotNull())


def split_report(split: DataFrame, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """Bounds and sizes per (keys, fold, role)."""
    return split.groupBy(*keys, "fold", "role").agg(
        F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count(F.lit(1)).alias("n_rows")
    )


def integrity(split: DataFrame, horizon_s: int, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """Per (keys, fold): rows in two roles, and whether the target horizon of
    training ends before the test starts."""
    keys = list(keys)
    per_row = split.groupBy(*keys, "fold", time).agg(F.count(F.lit(1)).alias("_roles"))
    twice = per_row.groupBy(*keys, "fold").agg(F.count_if(F.col("_roles") > 1).alias("rows_in_two_roles"))
    train, test = F.col("role") == "train", F.col("role") == "test"
    bounds = split.groupBy(*keys, "fold").agg(
        F.max(F.when(train, F.col(time))).alias("train_end"), F.min(F.when(test, F.col(time))).alias("test_start")
    )
    safe = micros("train_end") + horizon_s * MICRO < micros("test_start")
    return bounds.join(twice, [*keys, "fold"]).withColumn("horizon_clear", safe)


def stage_degradation(reports: DataFrame, metrics: Sequence[str], keys: Sequence[str] = KEYS, stage: str = "stage") -> DataFrame:
    """Evaluation against deployment per metric: value pair, gap, relative gap."""
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    long = reports.select(*keys, stage, F.explode(items).alias("i")).select(*keys, stage, "i.*")

    def of(name: str) -> Column:
        return F.max(F.when(F.col(stage) == name, F.col("value"))).alias(name)

    wide = long.groupBy(*keys, "metric").agg(of("evaluation"), of("deployment"))
    gap = F.col("deployment") - F.col("evaluation")
    return wide.withColumn("gap", gap).withColumn("relative_gap", div(gap, F.abs("evaluation")))


def overlaps(
    split: DataFrame, horizon_s: int, window_s: int, on: Sequence[str] = (*KEYS, "fold"), role: str = "role",
    time: str = "open_time", cell_s: int = DAY,
) -> DataFrame:
    """Rows whose spans reach into another role: (on, role, time, other_role, kind, n_other).

    A row at t holds an outcome over (t, t + horizon] and features over
    [t - window, t].  ``kind`` is "label" where its outcome shares time with the
    outcomes of ``n_other`` rows of the other role (|t - s| < horizon), and
    "feature" where its features look into them (t - window - horizon <= s < t).
    Any roles will do: train, validation and test, or stages.  Rows of one role
    are no leak of each other; a row given twice counts twice.  Rows without
    time, role or one of the keys are left out.

    Pairs are never formed.  Time bins tell which rows have another role near
    them, and only these ask; the answers are differences of running counts.
    """
    on, us, other = list(on), micros(F.col(time)), f"other_{role}"
    reach = max(1, (window_s + horizon_s) * MICRO)
    rows = split.select(*on, role, us.alias("_us")).dropna()
    binned = rows.withColumn("_bin", F.floor(F.col("_us") / reach).cast("long"))
    # One row per bin and role; a span reaches into the bin before or after at most.
    taken = binned.select(*on, F.col(role).alias(other), F.explode(F.array(*[F.col("_bin") + k for k in (-1, 0, 1)])).alias("_bin")).distinct()
    near = binned.join(taken, [*on, "_bin"]).where(F.col(role) != F.col(other)).select(*on, role, "_us", other)
    h, w = horizon_s * MICRO, window_s * MICRO
    # Each span (after, to] asks for the rows up to its end and, negative, for those before its start.
    asked = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(sign).alias("_sign"), (F.col("_us") + shift).alias("_at"))
        for kind, sign, shift in (("label", 1, h - 1), ("label", -1, -h), ("feature", 1, -1), ("feature", -1, -w - h - 1))
    ]))
    # Rows of equal (on, role, time) ask alike: one asks for all.
    asks = near.distinct().select(*on, F.col(role).alias("_asker"), "_us", F.col(other).alias("_role"), asked.alias("q")).select("*", "q.*").drop("q")
    points = rows.groupBy(*on, F.col(role).alias("_role"), F.col("_us").alias("_at")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    stacked = points.unionByName(asks.withColumn("_n", F.lit(0.0)), allowMissingColumns=True)
    stacked = stacked.withColumn("_time", F.timestamp_micros("_at")).withColumn("_asks", F.col("_asker").isNotNull())
    counted = running_sum(stacked, [*on, "_role"], "_time", ["_n"], cell_s, ties=["_asks"]).where("_asks")
    per_row = counted.groupBy(*on, F.col("_asker").alias(role), "_us", F.col("_role").alias(other), "kind").agg(
        F.sum(F.col("_sign") * F.col("_n_sum")).cast("long").alias("n_other")
    )
    return per_row.where("n_other > 0").select(
        *on, role, from_micros(F.col("_us"), is_ntz(split, time)).alias(time), other, "kind", "n_other"
    )


def overlap_report(found: DataFrame, on: Sequence[str] = (*KEYS, "fold"), role: str = "role", time: str = "open_time") -> DataFrame:
    """Number and bounds of the offending rows per (on, role, other role, kind)."""
    return found.groupBy(*on, role, f"other_{role}", "kind").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"),
        F.max("n_other").alias("most_others"),
    )
