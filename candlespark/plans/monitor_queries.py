"""Event-log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlespark.operators import monitor as E
from candlespark.plans.feature_queries import _as_of
from candlespark.plans.registry import query, r
from candlespark.plans.tables import MONITOR, monitor_events, monitor_targets, table
from candlespark.session import shared_dir
from candlespark.sources.events import advance_cursors, append_events, scan_events, scan_partials, stored_period_metrics

NOW = MONITOR + ", nw AS (SELECT max(ts) AS t FROM events)"


@query("event_ingest_counts", f"""
WITH {MONITOR}, b AS (SELECT * FROM mon UNION ALL SELECT * FROM mon WHERE event_type = 'inference'),
k AS (SELECT DISTINCT topic_id, address, event_id FROM b),
i AS (SELECT topic_id, address, count(*) AS inserted FROM k WHERE (topic_id, address, event_id) NOT IN
  (SELECT (topic_id, address, event_id) FROM mon WHERE observed_at < TIMESTAMP '2024-01-10') GROUP BY ALL),
f AS (SELECT topic_id, address, count(*) AS fetched FROM b GROUP BY ALL)
SELECT topic_id, address, fetched, coalesce(inserted, 0) AS inserted FROM f LEFT JOIN i USING (topic_id, address)""")
def _(spark, sf):
    """A batch with copies against a store that holds the first days."""
    e = monitor_events(spark, sf)
    batch = e.unionByName(e.where("event_type = 'inference'"))
    return E.ingest_counts(batch, e.where("observed_at < TIMESTAMP_NTZ '2024-01-10 00:00:00'"))


@query("event_ingest_rows", f"WITH {MONITOR} SELECT topic_id, address, event_id, event_type, {r('value_num')}, observed_at FROM mon WHERE observed_at >= TIMESTAMP '2024-01-10'")
def _(spark, sf):
    """The rows such a sync would add."""
    e = monitor_events(spark, sf)
    out = E.new_events(e.unionByName(e), e.where("observed_at < TIMESTAMP_NTZ '2024-01-10 00:00:00'"))
    return out.select("topic_id", "address", "event_id", "event_type", "value_num", "observed_at")


@query("event_store_syncs", f"""
WITH {MONITOR}, n AS (SELECT topic_id, address, count(*) AS fetched FROM mon GROUP BY ALL)
SELECT n.*, i AS sync, CASE WHEN i = 1 THEN fetched ELSE 0 END AS inserted FROM n, (SELECT unnest([1, 2]) AS i)""")
def _(spark, sf):
    """The same events fetched twice: all inserted by the first sync, none by the second."""
    path, e = shared_dir(spark, "event-store"), monitor_events(spark, sf)
    syncs = [append_events(e, path).withColumn("sync", F.lit(i)) for i in (1, 2)]
    return syncs[0].unionByName(syncs[1])


@query("event_store_rows", f"""
WITH {MONITOR} SELECT topic_id, address, count(*) AS n_stored, max(observed_at) AS last_sync_at FROM mon GROUP BY ALL""")
def _(spark, sf):
    """Late days and repeats appended in three syncs; what is stored, and the cursors after it."""
    path, e = shared_dir(spark, "event-store"), monitor_events(spark, sf)
    late = F.col("observed_at") < F.lit("2024-01-08").cast("timestamp_ntz")
    for batch in (e.where(~late), e.where(late).unionByName(e.where(~late & (F.col("event_type") == "score"))), e.where(late)):
        append_events(batch, path)
    stored = scan_events(spark, path).groupBy("topic_id", "address").agg(F.count(F.lit(1)).alias("n_stored"))
    return advance_cursors(e.select("topic_id", "address").distinct(), path).join(stored, ["topic_id", "address"])


@query("event_store_reobserved", f"WITH {MONITOR} SELECT topic_id, address, event_id, event_type, {r('value_num')}, observed_at FROM mon")
def _(spark, sf):
    """Every event observed again weeks before and after, in later syncs: the first observation stays, alone."""
    path, e = shared_dir(spark, "event-store"), monitor_events(spark, sf)
    for days in (0, 20, -30):
        append_events(e.withColumn("observed_at", F.col("observed_at") + F.expr(f"INTERVAL {days} DAYS")), path)
    return scan_events(spark, path).select("topic_id", "address", "event_id", "event_type", "value_num", "observed_at")


def _synced(spark, sf):
    """A store filled by syncs of new, late and repeated events."""
    path, e = shared_dir(spark, "event-store"), monitor_events(spark, sf)
    late = F.col("observed_at") < F.lit("2024-01-12").cast("timestamp_ntz")
    for batch in (e.where(~late), e.where(late & (F.col("event_type") != "score")), e):
        append_events(batch, path)
    return path


@query("event_fingerprints", f"""
WITH {MONITOR} SELECT topic_id, address, topic_id || '|' || address || '|' || event_type || '|' || coalesce(tx_hash, '') || '|'
  || strftime(observed_at, '%Y-%m-%d %H:%M:%S') || '|' || value_text AS event_id FROM mon""")
def _(spark, sf):
    """Ids for events that came without one."""
    e = monitor_events(spark, sf).withColumn("event_id", F.lit(None).cast("string"))
    e = e.withColumn("observed_at", F.date_trunc("second", "observed_at").cast("timestamp_ntz"))
    return E.normalise(e, F.lit(None).cast("timestamp_ntz")).select("topic_id", "address", "event_id")


@query("incremental_scan", f"""
WITH {MONITOR}, c AS (SELECT topic_id, address, CASE WHEN topic_id = 1 THEN TIMESTAMP '2024-01-20' ELSE deployed_at END - INTERVAL 30 SECOND AS f FROM targets)
SELECT topic_id, address, event_id, observed_at FROM mon JOIN c USING (topic_id, address) WHERE observed_at >= f""")
def _(spark, sf):
    """Events since each target's cursor, with the overlap."""
    t = monitor_targets(spark, sf).withColumn(
        "last_sync_at", F.when(F.col("topic_id") == 1, F.lit("2024-01-20").cast("timestamp_ntz")))
    return E.scan_since(monitor_events(spark, sf), t).select("topic_id", "address", "event_id", "observed_at")


@query("event_details", f"""
WITH {MONITOR} SELECT event_id, TRY_CAST(json_extract_string(details_json, '$.nonce') AS BIGINT) AS nonce,
  TRY_CAST(json_extract_string(details_json, '$.code') AS BIGINT) AS code, NULL::VARCHAR AS extra_data,
  CASE WHEN event_type = 'reward' THEN NULL ELSE date_trunc('second', observed_at)::TIMESTAMP END AS parsed_at FROM mon""")
def _(spark, sf):
    """Typed fields of the JSON details and ISO times; broken text gives NULL."""
    e = E.details(monitor_events(spark, sf))
    iso = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_type") == "reward", "soon").when(F.col("event_type") == "score", F.concat(iso, F.lit("Z"))).otherwise(iso)
    return e.select("event_id", "nonce", "code", "extra_data", E.parse_time(text).alias("parsed_at"))


@query("event_transactions", """
WITH t AS (SELECT 'h' || event_id AS txhash, CASE WHEN event_type = 'error' THEN 5 ELSE 0 END AS code, ts, user_id % 5 AS topic_id,
  json_extract_string(props, '$.k') AS nonce, CAST(value AS VARCHAR) AS v FROM events)
SELECT topic_id, p || ':' || txhash || ':' || nonce AS event_id, kind AS event_type, CASE WHEN code = 0 THEN 'success' ELSE 'error' END AS status,
  CASE WHEN kind = 'inference' THEN round(CAST(v AS DOUBLE), 6) + 0.0 END AS value_num, v AS value_text, txhash AS tx_hash, ts AS observed_at,
  CASE WHEN kind = 'submission' THEN '{"nonce":"' || nonce || '","code":' || code || '}' ELSE '{"nonce":"' || nonce || '"}' END AS details_json
FROM t, (SELECT unnest(['submit', 'inference']) AS p, unnest(['submission', 'inference']) AS kind)""")
def _(spark, sf):
    """Nested transaction events -> one submission and one inference row each."""
    e = table(spark, sf, "events")

    def attr(name, value):
        return F.struct(F.lit(name).alias("key"), F.concat(F.lit('"'), value.cast("string"), F.lit('"')).alias("value"))

    payload = F.array(attr("topic_id", F.col("user_id") % 5), attr("nonce", F.get_json_object("props", "$.k")), attr("value", F.col("value")))
    other = F.array(attr("amount", F.col("value")))
    events = F.array(
        F.struct(F.lit("transfer").alias("type"), other.alias("attributes")),
        F.struct(F.lit("worker_payload").alias("type"), payload.alias("attributes")),
    )
    txs = e.select(
        F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("txhash"),
        F.when(F.col("event_type") == "error", 5).otherwise(0).alias("code"), F.col("ts").alias("timestamp"), events.alias("events"),
    )
    return E.explode_transactions(txs, "worker_payload")


@query("snapshot_signals", """
WITH s AS (SELECT user_id % 5 AS topic_id, 'w' || (user_id % 30) AS address, ts, event_type, value, json_extract_string(props, '$.k')::INTEGER AS k FROM events),
u AS (SELECT topic_id, address, ts, floor(epoch(ts) / 300)::BIGINT AS b, unnest(['score', 'reward', 'whitelist', 'eligibility']) AS event_type,
  unnest(['score_ema', 'reward_fraction', 'whitelist', 'can_submit']) AS p,
  unnest([CASE WHEN event_type = 'view' THEN value END, CASE WHEN event_type = 'signup' THEN value END, CASE WHEN k < 50 THEN 1.0 ELSE 0.0 END, CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END]) AS value_num FROM s)
SELECT topic_id, address, p || ':' || topic_id || ':' || address || CASE WHEN event_type IN ('score', 'reward') THEN ':' || b ELSE '' END AS event_id,
  event_type, round(value_num, 6) + 0.0 AS value_num, 'snapshot' AS status, ts AS observed_at FROM u WHERE value_num IS NOT NULL""")
def _(spark, sf):
    """Score, reward, whitelist and eligibility reads -> event rows."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    signals = e.select(
        (F.col("user_id") % 5).alias("topic_id"), F.concat(F.lit("w"), (F.col("user_id") % 30).cast("string")).alias("address"), F.col("ts").alias("at"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("score"), F.when(F.col("event_type") == "signup", F.col("value")).alias("reward_fraction"),
        (k < 50).alias("whitelisted"), (k % 2 == 0).alias("can_submit"),
    )
    return E.snapshot_signals(signals).drop("value_text", "details_json")


@query("snapshot_inferences", """
WITH s AS (SELECT user_id % 5 AS topic_id, 'w' || (user_id % 30) AS address, ts, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_type = 'click')
SELECT topic_id, address, 'latest_inference:' || CASE WHEN k % 7 = 0 THEN '' ELSE k::VARCHAR END || ':' || address AS event_id, 'inference' AS event_type, round(value, 6) + 0.0 AS value_num,
  '{"block_height":' || CASE WHEN k % 7 = 0 THEN 0 ELSE k END || '}' AS details_json, 'snapshot' AS status, ts AS observed_at FROM s""")
def _(spark, sf):
    """Newest inferences read beside other signals -> event rows whose ids carry the block."""
    e = table(spark, sf, "events").where("event_type = 'click'")
    k = F.get_json_object("props", "$.k").cast("long")
    none = F.lit(None).cast("double")
    signals = e.select(
        (F.col("user_id") % 5).alias("topic_id"), F.concat(F.lit("w"), (F.col("user_id") % 30).cast("string")).alias("address"), F.col("ts").alias("at"),
        F.col("value").alias("inference"), F.when(k % 7 != 0, k).alias("block_height"), none.alias("score"), none.alias("reward_fraction"),
        F.lit(None).cast("boolean").alias("whitelisted"), F.lit(None).cast("boolean").alias("can_submit"),
    )
    return E.snapshot_signals(signals).drop("value_text")


COUNTS = """count(*) AS events_total, count(*) FILTER (WHERE event_type = 'inference') AS inference_count, count(*) FILTER (WHERE event_type = 'reward') AS reward_count,
 count(*) FILTER (WHERE event_type = 'score') AS score_count, count(*) FILTER (WHERE event_type = 'submission' AND status = 'success') AS submission_success,
 count(*) FILTER (WHERE event_type = 'submission' AND status = 'error') AS submission_error, round(coalesce(sum(value_num) FILTER (WHERE event_type = 'reward'), 0), 6) + 0.0 AS rewards_total"""


@query("deployment_rollup", f"WITH {MONITOR} SELECT topic_id, address, deployment_id, {COUNTS} FROM mon GROUP BY ALL")
def _(spark, sf):
    """Counts per topic, address and deployment."""
    return E.counts(monitor_events(spark, sf))


@query("target_summary", f"""
WITH {MONITOR}, more AS (SELECT topic_id, address, deployment_id FROM targets UNION ALL SELECT 99, 'idle', 'd0'),
m AS (SELECT mon.* FROM mon JOIN targets t USING (topic_id, address, deployment_id)), c AS (SELECT topic_id, address, {COUNTS} FROM m GROUP BY ALL)
SELECT topic_id, address, deployment_id, coalesce(events_total, 0) AS events_total, coalesce(inference_count, 0) AS inference_count, coalesce(reward_count, 0) AS reward_count,
  coalesce(score_count, 0) AS score_count, coalesce(submission_success, 0) AS submission_success, coalesce(submission_error, 0) AS submission_error, coalesce(rewards_total, 0) AS rewards_total
FROM more LEFT JOIN c USING (topic_id, address)""")
def _(spark, sf):
    """Counts per registered target, zeros for one without events."""
    t = monitor_targets(spark, sf)
    idle = spark.range(1).select(F.lit(99).cast("long").alias("topic_id"), F.lit("idle").alias("address"),
                                 F.lit(None).cast("timestamp_ntz").alias("deployed_at"), F.lit("d0").alias("deployment_id"))
    return E.summary_counts(monitor_events(spark, sf), t.unionByName(idle))


@query("latest_inference", f"""
WITH {MONITOR}, q AS (SELECT m.*, m.value_num > 20 AS sure FROM (SELECT * REPLACE (CASE WHEN value_num > 20 THEN value_num ELSE 0 END AS value_num, 'snapshot' AS status) FROM mon) m
  JOIN targets USING (topic_id, address, deployment_id) WHERE event_type = 'inference'),
k AS (SELECT *, row_number() OVER (PARTITION BY topic_id, address ORDER BY sure DESC, observed_at DESC, event_id DESC) AS k FROM q)
SELECT topic_id, address, observed_at, value_text, {r('value_num')}, tx_hash FROM k WHERE k = 1""")
def _(spark, sf):
    """Newest confirmed inference per target; zero snapshots are passed over."""
    e = monitor_events(spark, sf)
    e = e.withColumn("value_num", F.when(F.col("value_num") > 20, F.col("value_num")).otherwise(0.0)).withColumn("status", F.lit("snapshot"))
    return E.latest_inference(e, monitor_targets(spark, sf))


def _latest_sql(kind: str) -> str:
    return f"""
WITH {MONITOR}, q AS (SELECT mon.*, mon.deployment_id = t.deployment_id AS mine FROM mon JOIN targets t USING (topic_id, address) WHERE event_type = '{kind}'),
k AS (SELECT *, row_number() OVER (PARTITION BY topic_id, address ORDER BY mine DESC, observed_at DESC, event_id DESC) AS k FROM q)
SELECT topic_id, address, observed_at, value_text, {r('value_num')}, tx_hash FROM k WHERE k = 1"""


@query("latest_score", _latest_sql("score"))
def _(spark, sf):
    """Newest score of the target's deployment, else of any."""
    return E.latest_value(monitor_events(spark, sf), monitor_targets(spark, sf), "score")


@query("latest_reward", _latest_sql("reward"))
def _(spark, sf):
    """Newest reward of the target's deployment, else of any."""
    return E.latest_value(monitor_events(spark, sf), monitor_targets(spark, sf), "reward")


PERIOD = NOW + """, pr AS (SELECT unnest(['24h', '7d', '30d']) AS period, unnest([INTERVAL 24 HOUR, INTERVAL 7 DAY, INTERVAL 30 DAY]) AS w),
j AS (SELECT mon.*, pr.period, mon.deployment_id = t.deployment_id AS mine FROM mon JOIN targets t USING (topic_id, address), pr, nw WHERE observed_at >= nw.t - pr.w),
al AS (SELECT topic_id, address, count(*) FILTER (WHERE mine AND event_type IN ('score', 'reward')) = 0 AS use_all FROM j GROUP BY ALL),
u AS (SELECT j.* FROM j JOIN al USING (topic_id, address) WHERE mine OR use_all),
g AS (SELECT topic_id, address, period, count(*) FILTER (WHERE event_type = 'submission' AND status = 'success') AS submission_success,
  count(*) FILTER (WHERE event_type = 'submission' AND status = 'error') AS submission_error, count(*) FILTER (WHERE event_type = 'inference') AS inference_count,
  count(*) FILTER (WHERE event_type = 'score') AS score_samples, avg(value_num) FILTER (WHERE event_type = 'score') AS score_avg,
  count(*) FILTER (WHERE event_type = 'reward') AS reward_fraction_samples, sum(value_num) FILTER (WHERE event_type = 'reward') AS reward_fraction_sum,
  avg(value_num) FILTER (WHERE event_type = 'reward') AS reward_fraction_avg FROM u GROUP BY ALL)
SELECT t.topic_id, t.address, pr.period, coalesce(submission_success, 0) AS submission_success, coalesce(submission_error, 0) AS submission_error,
  coalesce(inference_count, 0) AS inference_count, coalesce(score_samples, 0) AS score_samples, coalesce(reward_fraction_samples, 0) AS reward_fraction_samples, """


@query("period_metrics", f"WITH {PERIOD} {r('coalesce(reward_fraction_sum, 0) AS reward_fraction_sum', 'score_avg', 'reward_fraction_avg')} FROM targets t CROSS JOIN pr LEFT JOIN g ON g.topic_id = t.topic_id AND g.address = t.address AND g.period = pr.period")
def _(spark, sf):
    """Trailing 24 h, 7 d and 30 d metrics per target, in one scan."""
    return E.period_metrics(monitor_events(spark, sf), monitor_targets(spark, sf), _as_of(spark, sf))


@query("stored_period_metrics", f"WITH {PERIOD} {r('coalesce(reward_fraction_sum, 0) AS reward_fraction_sum', 'score_avg', 'reward_fraction_avg')} FROM targets t CROSS JOIN pr LEFT JOIN g ON g.topic_id = t.topic_id AND g.address = t.address AND g.period = pr.period")
def _(spark, sf):
    """The same from the hourly partials that syncs wrote, after late and repeated batches."""
    now = table(spark, sf, "events").agg(F.max("ts").alias("t")).first().t
    return stored_period_metrics(spark, _synced(spark, sf), monitor_targets(spark, sf), now)


@query("stored_rollup", f"WITH {MONITOR} SELECT topic_id, address, deployment_id, {COUNTS} FROM mon GROUP BY ALL")
def _(spark, sf):
    """Counts per topic, address and deployment, merged from the partials."""
    return E.counts_of_partials(scan_partials(spark, _synced(spark, sf)))


@query("stored_latest_score", _latest_sql("score"))
def _(spark, sf):
    """Newest score per target, merged from the partials."""
    return E.latest_of_partials(scan_partials(spark, _synced(spark, sf)), monitor_targets(spark, sf), "score")


@query("event_series_per_target", f"""
WITH {MONITOR}, k AS (SELECT *, row_number() OVER (PARTITION BY topic_id, address ORDER BY observed_at DESC, event_id DESC) AS k FROM mon)
SELECT topic_id, address, event_id, event_type, status, {r('value_num')}, observed_at FROM k WHERE k <= 20""")
def _(spark, sf):
    """The newest 20 events of each target."""
    return E.event_series(monitor_events(spark, sf), 20).select("topic_id", "address", "event_id", "event_type", "status", "value_num", "observed_at")


@query("event_series_newest", f"""
WITH {MONITOR} SELECT topic_id, address, event_id, {r('value_num')}, observed_at FROM mon WHERE event_type = 'submission' AND deployment_id = 'd1'
ORDER BY observed_at DESC, event_id DESC LIMIT 200""")
def _(spark, sf):
    """The newest 200 submissions of one deployment."""
    out = E.event_series(monitor_events(spark, sf), 200, "submission", "d1", keys=None)
    return out.select("topic_id", "address", "event_id", "value_num", "observed_at")


TIMELINE = NOW + """, sl AS (SELECT topic_id, address, 99 AS cur, 3 AS ep, max(deployment_id) AS dep FROM mon GROUP BY 1, 2),
ex AS (SELECT *, unnest(range(25)) AS slot FROM sl), nx AS (SELECT *, cur - slot * ep AS nonce FROM ex),
sb AS (SELECT mon.*, json_extract_string(details_json, '$.nonce')::BIGINT AS nonce, json_extract_string(details_json, '$.code')::BIGINT AS code FROM mon JOIN sl USING (topic_id, address)
  WHERE event_type = 'submission' {dep}),
b AS (SELECT *, row_number() OVER (PARTITION BY topic_id, address, nonce ORDER BY observed_at DESC, event_id DESC) AS k FROM sb)
SELECT nx.topic_id, nx.address, nx.slot::INTEGER AS slot, nx.nonce::BIGINT AS nonce, t - to_seconds(nx.slot * ep * 3) AS ts, CASE WHEN b.event_id IS NULL THEN 'missed' WHEN b.status = 'success' THEN 'success' ELSE 'error' END AS status,
  b.observed_at, b.value_text, b.tx_hash, b.code FROM nx CROSS JOIN nw LEFT JOIN b ON b.topic_id = nx.topic_id AND b.address = nx.address AND b.nonce = nx.nonce AND b.k = 1"""


def _slots(spark, sf):
    e = monitor_events(spark, sf)
    return e.groupBy("topic_id", "address").agg(F.max("deployment_id").alias("deployment_id")).select(
        "*", F.lit(99).cast("long").alias("current_nonce"), F.lit(3).alias("epoch_length"))


@query("submission_timeline", f"WITH {TIMELINE.replace('{dep}', '')}")
def _(spark, sf):
    """The last 25 expected nonces per target: success, error or missed."""
    return E.submission_timeline(monitor_events(spark, sf), _slots(spark, sf), _as_of(spark, sf)).drop("extra_data")


@query("submission_timeline_deployment", f"WITH {TIMELINE.replace('{dep}', 'AND mon.deployment_id = sl.dep')}")
def _(spark, sf):
    """The same, counting one deployment only."""
    return E.submission_timeline(monitor_events(spark, sf), _slots(spark, sf), _as_of(spark, sf), deployment=True).drop("extra_data")


@query("submission_timeline_extra", f"""
WITH {TIMELINE.replace('{dep}', '').replace('b.code FROM', "b.code, CASE WHEN b.code = 5 THEN 'x' || b.event_id END AS extra_data FROM")}""")
def _(spark, sf):
    """The timeline with the extra data that failed submissions carry."""
    e = monitor_events(spark, sf)
    extra = F.concat(F.regexp_replace("details_json", r"\}$", ', "extra_data": "x'), F.col("event_id"), F.lit('"}'))
    failed = F.get_json_object("details_json", "$.code") == "5"
    return E.submission_timeline(e.withColumn("details_json", F.when(failed, extra).otherwise(F.col("details_json"))), _slots(spark, sf), _as_of(spark, sf))


@query("merged_targets", f"""
WITH {MONITOR}, cur AS (SELECT topic_id, address, deployed_at, deployment_id, true AS enabled FROM targets WHERE topic_id < 3),
ch AS (SELECT topic_id, address, deployed_at + INTERVAL 1 DAY AS deployed_at, CASE WHEN topic_id = 2 THEN 'dnew' END AS deployment_id, topic_id <> 4 AS enabled FROM targets WHERE topic_id > 1)
SELECT coalesce(c.topic_id, h.topic_id) AS topic_id, coalesce(c.address, h.address) AS address, coalesce(c.deployed_at, h.deployed_at) AS deployed_at,
  coalesce(h.deployment_id, c.deployment_id) AS deployment_id, coalesce(h.enabled, c.enabled) AS enabled
FROM cur c FULL JOIN ch h ON c.topic_id = h.topic_id AND c.address = h.address""")
def _(spark, sf):
    """Registry merge: insert new, keep old times, take new deployment ids."""
    t = monitor_targets(spark, sf)
    cur = t.where("topic_id < 3").withColumn("enabled", F.lit(True))
    ch = t.where("topic_id > 1").select(
        "topic_id", "address", (F.col("deployed_at") + F.expr("INTERVAL 1 DAY")).alias("deployed_at"),
        F.when(F.col("topic_id") == 2, "dnew").alias("deployment_id"), (F.col("topic_id") != 4).alias("enabled"))
    return E.merge_targets(cur, ch)


HISTORY = MONITOR + """, dp AS (SELECT topic_id, address, deployment_id, min(observed_at) AS deployed_at FROM mon GROUP BY ALL),
hi AS (SELECT *, lead(deployed_at) OVER (PARTITION BY topic_id, address ORDER BY deployed_at, deployment_id) AS ended_at FROM dp)"""


def _history(spark, sf):
    e = monitor_events(spark, sf)
    return E.deployment_history(e.groupBy("topic_id", "address", "deployment_id").agg(F.min("observed_at").alias("deployed_at")))


@query("deployment_history", f"WITH {HISTORY} SELECT *, ended_at IS NULL AS is_active FROM hi")
def _(spark, sf):
    """Deployments with their end and the active one."""
    return _history(spark, sf)


@query("active_deployments", f"""
WITH {HISTORY} SELECT t.topic_id, t.address, hi.deployment_id AS active_deployment, hi.deployed_at AS active_since
FROM targets t JOIN hi ON t.topic_id = hi.topic_id AND t.address = hi.address AND hi.ended_at IS NULL""")
def _(spark, sf):
    """Targets with their active deployment."""
    out = E.active_deployments(monitor_targets(spark, sf), _history(spark, sf))
    return out.select("topic_id", "address", "active_deployment", "active_since")


@query("events_to_deployments", f"""
WITH {HISTORY} SELECT m.event_id, m.topic_id, m.address, m.observed_at, hi.deployment_id AS active_deployment, hi.deployed_at AS start, hi.ended_at
FROM mon m JOIN hi ON m.topic_id = hi.topic_id AND m.address = hi.address AND m.observed_at >= hi.deployed_at AND (hi.ended_at IS NULL OR m.observed_at < hi.ended_at)""")
def _(spark, sf):
    """Each event with the deployment active at its time."""
    e = monitor_events(spark, sf).select("event_id", "topic_id", "address", "observed_at")
    return E.events_to_deployments(e, _history(spark, sf)).select("event_id", "topic_id", "address", "observed_at", "active_deployment", "start", "ended_at")


@query("address_health", f"""
WITH {MONITOR}, w AS (SELECT topic_id, address, CASE arg_max(event_type, (observed_at, event_id)) WHEN 'submission' THEN 'running' WHEN 'reward' THEN 'crashed' ELSE 'running' END AS status,
  CASE WHEN arg_max(status, (observed_at, event_id)) = 'error' THEN 'failed' END AS last_error FROM mon GROUP BY ALL),
h AS (SELECT *, CASE WHEN status = 'running' AND last_error IS NULL THEN 'good' WHEN status = 'crashed' THEN 'bad' ELSE 'degraded' END AS health FROM w)
SELECT address, count(*) FILTER (WHERE status = 'running') AS running, count(*) AS total,
  string_agg(topic_id || ':' || status || ':' || health, ',' ORDER BY topic_id) AS workers FROM h GROUP BY 1""")
def _(spark, sf):
    """Per address: running workers, all workers, health by topic."""
    e = monitor_events(spark, sf)
    rank = F.struct("observed_at", "event_id")
    w = e.groupBy("topic_id", "address").agg(F.max_by("event_type", rank).alias("k"), F.max_by("status", rank).alias("s"))
    w = w.select("topic_id", "address", F.when(F.col("k") == "reward", "crashed").otherwise("running").alias("status"),
                 F.when(F.col("s") == "error", "failed").alias("last_error"))
    out = E.address_rollup(w)
    text = F.array_join(F.transform("workers", lambda x: F.concat_ws(":", x["topic_id"].cast("string"), x["status"], x["health"])), ",")
    return out.select("address", "running", "total", text.alias("workers"))


@query("worker_dashboard", f"""
WITH {MONITOR}, w AS (SELECT DISTINCT c_nationkey % 5 AS topic_id, 'w' || (c_custkey % 60) AS address FROM customer), c AS (SELECT topic_id, address, {COUNTS} FROM mon GROUP BY ALL)
SELECT w.topic_id::BIGINT AS topic_id, w.address, coalesce(submission_success, 0) AS submission_success, coalesce(submission_error, 0) AS submission_error,
  coalesce(inference_count, 0) AS inference_count, coalesce(rewards_total, 0) AS rewards_total
FROM w LEFT JOIN c ON c.topic_id = w.topic_id AND c.address = w.address""")
def _(spark, sf):
    """Workers left-joined with their counts, zeros where there are none."""
    cust = table(spark, sf, "customer")
    w = cust.select((F.col("c_nationkey") % 5).cast("long").alias("topic_id"), F.concat(F.lit("w"), (F.col("c_custkey") % 60).cast("string")).alias("address")).distinct()
    c = E.counts(monitor_events(spark, sf), E.TARGET)
    cols = ["submission_success", "submission_error", "inference_count", "rewards_total"]
    return w.join(c.select(*E.TARGET, *cols), E.TARGET, "left").na.fill(0, cols)
