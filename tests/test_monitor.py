"""Event operators beyond what the SQL twins hold."""

from datetime import datetime

from pyspark.sql import functions as F

from candlespark.operators import monitor as E

AT = datetime(2026, 1, 1)


def test_timeline_carries_extra_data(spark):
    rows = [(1, "w", "d", f"e{k}", "submission", "success", "1.5", "h", AT, d) for k, d in enumerate(['{"nonce": 9, "code": 0, "extra_data": "x"}', '{"nonce": 6}'])]
    names = "topic_id long, address string, deployment_id string, event_id string, event_type string, status string, value_text string, tx_hash string, observed_at timestamp_ntz, details_json string"
    slots = spark.createDataFrame([(1, "w", 9, 3)], "topic_id long, address string, current_nonce long, epoch_length long")
    got = E.submission_timeline(spark.createDataFrame(rows, names), slots, F.lit(AT).cast("timestamp_ntz"), 3).collect()
    assert sorted((r.nonce, r.status, r.extra_data) for r in got) == [(3, "missed", None), (6, "success", None), (9, "success", "x")]


def test_snapshot_of_latest_inference(spark):
    names = "topic_id long, address string, at timestamp_ntz, score double, reward_fraction double, whitelisted boolean, can_submit boolean, inference string, block_height long"
    signals = spark.createDataFrame([(1, "w", AT, None, None, None, True, "0.25", 77), (1, "v", AT, None, None, None, None, "odd", None), (1, "u", AT, None, None, None, None, None, 78)], names)
    got = {(r.event_id, r.event_type, r.status, r.value_num, r.value_text, r.details_json) for r in E.snapshot_signals(signals).collect()}
    assert got == {
        ("latest_inference:77:w", "inference", "snapshot", 0.25, "0.25", '{"block_height":77}'),
        ("can_submit:1:w", "eligibility", "snapshot", 1.0, "true", None),
        ("latest_inference::v", "inference", "snapshot", None, "odd", '{"block_height":0}'),
    }
    assert {r.event_type for r in E.snapshot_signals(signals.drop("inference", "block_height")).collect()} == {"eligibility"}
