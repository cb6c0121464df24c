"""What the physical plans must and must not hold."""

import re

import pytest

from candlespark.plans.catalogue import QUERIES


def plan(spark, sf, name):
    df = QUERIES[name](spark, sf)
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


JOINS = [
    "asof_external", "backfill_plan", "calibration_bins", "cross_asset_features", "densify_linear", "event_ingest_counts",
    "events_to_deployments", "excess_target", "feature_drift", "latest_inference", "live_features", "merged_targets", "param_grid",
    "parameter_sensitivity", "period_metrics", "regime_gate", "resample_live_15m", "source_alignment", "spearman_correlation",
    "feature_drift_sketched", "graded_grid", "split_overlaps", "stage_overlaps", "submission_timeline", "time_series_split", "train_only_scaling", "truncation_audit", "zptae_improvement",
]


@pytest.mark.parametrize("name", JOINS)
def test_no_cross_products(spark, small, name):
    text = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["training_table", "horizon_features", "evaluate_per_symbol", "spearman_correlation", "regime_gate", "baseline_errors"])
def test_input_is_read_once(spark, small, name):
    """Branches of the block helpers share one shuffle."""
    assert len(re.findall("FileScan", plan(spark, small, name))) == 1


def test_windows_are_cut_into_blocks(spark, small):
    text = plan(spark, small, "horizon_features")
    parts = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[[^\]]*\]", text)
    # By block, by cell, and by symbol for the small table of cell counts only.
    assert sum("_block" in p for p in parts) >= 2
    assert sum("_block" not in p and "_cell" not in p for p in parts) <= 1


def test_columns_are_pruned(spark, small):
    text = QUERIES["bars_1h"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "user_id" not in re.search(r"ReadSchema: struct<(.*?)>", text).group(1)


@pytest.mark.parametrize("name", ["period_metrics", "incremental_scan"])
def test_time_bounds_reach_the_scan(spark, small, name):
    text = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan(OrEqual)?\(ts,", text)
