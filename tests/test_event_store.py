"""The event store's key index, its partials, and syncs that were cut off."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from candlespark.operators import monitor as E
from candlespark.plans.tables import monitor_events, monitor_targets
from candlespark.session import shared_dir
from candlespark.sources import events as S

SCHEMA = "topic_id long, address string, deployment_id string, event_id string, event_type string, status string, value_num double, value_text string, tx_hash string, observed_at timestamp_ntz, details_json string"


def event(key, day, value=1.0, topic=1, kind="score", hour=1):
    return (topic, "w", "d", key, kind, "snapshot", value, str(value), None, dt.datetime(2024, 1, day, hour), None)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def stored(spark, path):
    return sorted((r.event_id, r.observed_at.day, r.value_num) for r in S.scan_events(spark, path).collect())


def test_one_key_on_two_far_days_is_one_event(spark):
    path = shared_dir(spark, "events")
    S.append_events(frame(spark, event("a", 20, 2.0)), path)
    report = S.append_events(frame(spark, event("a", 1, 1.0), event("b", 1), event("a", 20, 2.0, topic=2)), path)
    assert stored(spark, path) == [("a", 20, 2.0), ("a", 20, 2.0), ("b", 1, 1.0)]
    assert sorted((r.topic_id, r.fetched, r.inserted) for r in report.collect()) == [(1, 2, 1), (2, 1, 1)]


def test_copies_in_one_batch_and_empty_batches(spark):
    path = shared_dir(spark, "events")
    S.append_events(frame(spark, event("a", 5, 5.0), event("a", 3, 3.0)), path)
    assert S.append_events(frame(spark, event("a", 5)).limit(0), path).count() == 0
    assert stored(spark, path) == [("a", 3, 3.0)]
    assert S.scan_partials(spark, shared_dir(spark, "none")).count() == 0


def test_sync_reads_its_own_buckets(spark):
    path = shared_dir(spark, "events")
    S.append_events(frame(spark, *[event(f"e{i}", 1 + i % 20) for i in range(300)]), path)
    number = frame(spark, event("e7", 9)).select(S.bucket().alias("b")).first().b
    keys = S.stored_keys(spark, path, [number])
    plan = keys._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert f"{number}" in filters and "bucket" in filters
    assert "e7" in {r.event_id for r in keys.collect()} and keys.count() < 30


@pytest.mark.parametrize("done", ["nothing", "events", "partials", "keys"])
def test_a_sync_that_was_cut_off_is_finished(spark, monkeypatch, done):
    """Whatever step it reached: no event is lost or doubled, and the partials say the same."""
    path = shared_dir(spark, "events")
    S.append_events(frame(spark, event("old", 2)), path)

    class CutOff(Exception):
        pass

    def stop(*_, **__):
        raise CutOff

    with monkeypatch.context() as m:
        if done == "nothing":
            m.setattr(S, "_commit", stop)
        elif done == "events":
            m.setattr(S, "partials", stop)
        elif done == "partials":
            m.setattr(S, "_add_keys", stop)
        else:
            keep, calls = S.remove_dir, []
            m.setattr(S, "remove_dir", lambda s, p: stop() if S.PENDING in p else keep(s, p) or calls.append(p))
        with pytest.raises(CutOff):
            S.append_events(frame(spark, event("a", 4), event("b", 5)), path)
    S.append_events(frame(spark, event("a", 9), event("c", 6)), path)
    assert [k for k, *_ in stored(spark, path)] == ["a", "b", "c", "old"]
    assert [r.events_total for r in E.counts_of_partials(S.scan_partials(spark, path)).collect()] == [4]


def test_store_without_index_gets_one(spark):
    path = shared_dir(spark, "events")
    rows = frame(spark, event("a", 4), event("b", 5))
    rows.withColumn(S.DAY, F.to_date("observed_at")).write.partitionBy(S.DAY).parquet(path)
    S.append_events(frame(spark, event("a", 25), event("c", 6)), path)
    assert [k for k, *_ in stored(spark, path)] == ["a", "b", "c"]
    assert [r.events_total for r in E.counts_of_partials(S.scan_partials(spark, path)).collect()] == [3]


@pytest.mark.parametrize("as_of", ["2024-01-20 13:27:11.5", "2024-01-15 00:00:00", "2024-02-20 03:00:00"])
def test_partials_give_what_the_log_gives(spark, small, as_of):
    """Windows that begin within an hour, on one, and in the middle of nothing."""
    path = shared_dir(spark, "events")
    log, targets = monitor_events(spark, small), monitor_targets(spark, small)
    half = F.col("event_id") < "e5"
    for batch in (log.where(half), log, log.where(~half)):
        S.append_events(batch, path)

    def rows(df):
        return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())

    now = F.lit(as_of).cast("timestamp_ntz")
    assert rows(S.stored_period_metrics(spark, path, targets, as_of)) == rows(E.period_metrics(log, targets, now))
    kept = S.scan_partials(spark, path)
    assert rows(E.counts_of_partials(kept)) == rows(E.counts(log))
    assert rows(E.latest_of_partials(kept, targets, "inference")) == rows(E.latest_inference(log, targets))
    assert rows(E.latest_of_partials(kept, targets, "reward")) == rows(E.latest_value(log, targets, "reward"))


def test_reports_leave_the_log_alone(spark, small):
    """Events are read for the hours in which windows begin; all else comes from one scan of the partials."""
    path = shared_dir(spark, "events")
    S.append_events(monitor_events(spark, small), path)
    plan = S.stored_period_metrics(spark, path, monitor_targets(spark, small).cache(), "2024-01-20 12:30:00")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and path.split("/")[-1] in line]
    assert len([s for s in scans if "_partials" in s]) == 1
    assert all("observed_day" in s[s.index("PartitionFilters") :] for s in scans if "_partials" not in s) and len(scans) == 2


def test_a_large_day_is_written_by_several_tasks(spark):
    path, conf = shared_dir(spark, "events"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    text = F.sha2(F.col("id").cast("string"), 256)
    rows = spark.range(0, 200_000, 1, 8).select(
        F.lit(1).cast("long").alias("topic_id"), F.lit("w").alias("address"), F.lit("d").alias("deployment_id"), text.alias("event_id"),
        F.lit("score").alias("event_type"), F.lit("snapshot").alias("status"), F.col("id").cast("double").alias("value_num"), text.alias("value_text"),
        text.alias("tx_hash"), (F.lit("2024-01-05").cast("timestamp_ntz") + F.make_interval(secs=F.col("id") % 86_400)).alias("observed_at"), text.alias("details_json"))
    spark.conf.set(conf, "1m")
    try:
        S.append_events(rows, path)
    finally:
        spark.conf.unset(conf)
    assert len([n for n in S._names(spark, f"{path}/observed_day=2024-01-05") if n.endswith(".parquet")]) > 2
    assert S.scan_events(spark, path).select("event_id").distinct().count() == S.scan_events(spark, path).count() == 200_000


def test_a_sync_without_news_writes_nothing(spark):
    path = shared_dir(spark, "events")
    for _ in range(2):
        report = S.append_events(frame(spark, event("a", 4), event("b", 5)), path)
    assert [(r.fetched, r.inserted) for r in report.collect()] == [(2, 0)]
    assert len([n for n in S._names(spark, f"{path}/{S.PARTIALS}") if n.startswith("sync=")]) == 1
    assert S._names(spark, f"{path}/{S.PENDING}") == []


def test_one_copy_of_a_row_goes_through_the_shuffle(spark):
    rows = frame(spark, event("a", 5, 5.0), event("a", 3, 3.0), event("a", 3, 2.0), event("b", 5))
    fresh = E.new_events(rows, rows.where("event_id = 'b'"))
    assert [(r.event_id, r.observed_at.day, r.value_num) for r in fresh.collect()] == [("a", 3, 2.0)]
    plan = fresh._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("details_json, details_json#") == 1
