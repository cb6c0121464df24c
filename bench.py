"""Times the headline queries and prints one JSON line.

Input: ``$BENCH_SF_DIR`` (default the sf0.1 tables), ``local[$BENCH_CPUS]``.
Each query is planned anew and run to a sink that drops the rows; ``--all``
times every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from candlespark.plans.catalogue import QUERIES  # noqa: E402
from candlespark.session import local_session  # noqa: E402

HEADLINE = [
    "bars_1h",
    "bars_1d",
    "resample_live_15m",
    "window_features_long",
    "training_table",
    "technical_features",
    "horizon_features",
    "asof_external",
    "densify_linear",
    "backfill_plan",
    "evaluate_per_symbol",
    "spearman_correlation",
    "baseline_errors",
    "walk_forward_expanding",
    "feature_drift",
    "period_metrics",
    "submission_timeline",
    "event_ingest_counts",
    "stream_resample",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "candlespark-bench")
    names = list(QUERIES) if "--all" in sys.argv else HEADLINE
    # One pass over the smallest tables loads classes before the clock starts.
    warm = str(Path(sf_dir).parent / "sf0.001")
    if os.path.isdir(warm):
        for name in ("training_table", "evaluate_per_symbol"):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
