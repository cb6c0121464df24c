"""Analytics over the event log of deployed models.

The log is the large side.  Every rollup first aggregates it per (topic,
address, deployment), which combines rows before the shuffle, and joins
registries and slots to the small result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlespark.functions.safe import div
from candlespark.functions.times import MICRO, add_seconds, micros
from candlespark.operators.asof import interval_join
from candlespark.operators.blocks import DAY, MINUTE, over_blocks
from candlespark.schema import EVENT_KEY, EVENT_SCHEMA

TARGET = ["topic_id", "address"]

# Trailing windows, overlap of incremental reads, block time, id formats.
PERIODS = {"24h": DAY, "7d": 7 * DAY, "30d": 30 * DAY}
OVERLAP_S = 30
BLOCK_SECONDS = 3
BUCKET_S = 300
SIGNAL_IDS = {"score": "score_ema", "reward": "reward_fraction", "whitelist": "whitelist", "eligibility": "can_submit"}


# ------------------------------------------------------------------- ingest
def fingerprint() -> Column:
    """Event id of rows that came without one."""
    value = F.coalesce(F.col("value_text"), F.col("value_num").cast("string"), F.lit(""))
    parts = [
        F.col("topic_id").cast("string"), F.col("address"), F.coalesce("event_type", F.lit("unknown")),
        F.coalesce("tx_hash", F.lit("")), F.coalesce(F.col("observed_at").cast("string"), F.lit("")), value,
    ]
    return F.concat_ws("|", *parts)


def normalise(events: DataFrame, as_of: Column) -> DataFrame:
    """Fill in missing ids, types and times."""
    return (
        events.withColumn("event_id", F.coalesce("event_id", fingerprint()))
        .withColumn("event_type", F.coalesce("event_type", F.lit("unknown")))
        .withColumn("observed_at", F.coalesce("observed_at", as_of))
    )


def new_events(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of the batch that the store lacks, one per key.

    Copies inside the batch are combined by an aggregate before the shuffle;
    of equal keys the earliest stays, as with insert-or-ignore.
    """
    # The smallest whole row, which begins with its time: one copy of it in the shuffle.
    rest = ["observed_at", *[c for c in batch.columns if c not in (*EVENT_KEY, "observed_at")]]
    first = batch.groupBy(*EVENT_KEY).agg(F.min(F.struct(*rest)).alias("_v"))
    fresh = first.select(*EVENT_KEY, "_v.*").select(*batch.columns)
    return fresh.join(store.select(*EVENT_KEY), EVENT_KEY, "left_anti")


def ingest_counts(batch: DataFrame, store: DataFrame) -> DataFrame:
    """(topic, address, fetched, inserted) of one sync."""
    fetched = batch.groupBy(*TARGET).agg(F.count(F.lit(1)).alias("fetched"))
    added = new_events(batch, store).groupBy(*TARGET).agg(F.count(F.lit(1)).alias("inserted"))
    return fetched.join(added, TARGET, "left").select(*TARGET, "fetched", F.coalesce("inserted", F.lit(0)).alias("inserted"))


def scan_since(events: DataFrame, targets: DataFrame, since: str | None = None) -> DataFrame:
    """Events from 30 seconds before each target's cursor on.

    The cursor is ``since``, else the last sync, else the deployment time; the
    overlap is harmless because ingest is idempotent.
    """
    start = F.coalesce(F.lit(since).cast("timestamp_ntz"), "last_sync_at", "deployed_at")
    cursors = targets.select(*TARGET, add_seconds(start, -OVERLAP_S).alias("_from"))
    # The oldest cursor, one value, bounds the scan; each target's own follows after the join.
    oldest = cursors.agg(F.min("_from").alias("t")).first()["t"]
    if oldest is not None:
        events = events.where(F.col("observed_at") >= F.lit(oldest).cast(events.schema["observed_at"].dataType))
    return events.join(cursors, TARGET).where(F.col("observed_at") >= F.col("_from")).drop("_from")


def details(events: DataFrame) -> DataFrame:
    """Typed fields of ``details_json``; broken text gives NULL."""

    def text(name: str) -> Column:
        return F.get_json_object("details_json", f"$.{name}")

    return events.select(
        "*",
        text("nonce").try_cast("long").alias("nonce"),
        text("code").try_cast("long").alias("code"),
        text("extra_data").alias("extra_data"),
    )


def parse_time(text: Column) -> Column:
    """ISO time with Z, an offset or none (then UTC) -> UTC; NULL for other text."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def explode_transactions(txs: DataFrame, payload_type: str, topic_id: int | None = None) -> DataFrame:
    """Transactions with nested events -> a submission and an inference row per payload.

    ``events`` is array<struct<type, attributes: array<struct<key, value>>>>;
    attribute values may be wrapped in quotes.
    """
    ev = txs.select("txhash", "code", "timestamp", F.explode("events").alias("e")).where(F.col("e.type") == payload_type)
    attrs = F.map_from_entries(F.col("e.attributes"))
    flat = ev.withColumn("_a", attrs)

    def attr(name: str) -> Column:
        return F.trim(F.coalesce(F.try_element_at("_a", F.lit(name)), F.lit("")), F.lit('"'))

    flat = flat.select("txhash", "code", "timestamp", attr("topic_id").alias("topic"), attr("nonce").alias("nonce"), attr("value").alias("value_text"))
    if topic_id is not None:
        flat = flat.where(F.col("topic") == str(topic_id))
    kinds = F.explode(F.array(F.struct(F.lit("submission").alias("event_type"), F.lit("submit").alias("p")),
                              F.struct(F.lit("inference").alias("event_type"), F.lit("inference").alias("p")))).alias("k")
    out = flat.select("*", kinds)
    is_sub = F.col("k.event_type") == "submission"
    code = F.coalesce("code", F.lit(0))
    return out.select(
        F.col("topic").try_cast("long").alias("topic_id"),
        F.concat_ws(":", "k.p", "txhash", "nonce").alias("event_id"),
        "k.event_type",
        F.when(code == 0, "success").otherwise("error").alias("status"),
        F.when(~is_sub, F.col("value_text").try_cast("double")).alias("value_num"),
        "value_text",
        F.col("txhash").alias("tx_hash"),
        F.col("timestamp").alias("observed_at"),
        F.when(is_sub, F.to_json(F.struct("nonce", code.alias("code")))).otherwise(F.to_json(F.struct("nonce"))).alias("details_json"),
    )


def snapshot_signals(signals: DataFrame) -> DataFrame:
    """Point-in-time signals (topic, address, at, score, reward_fraction,
    whitelisted, can_submit) -> event rows; NULL signals give none.

    ``signals`` may also hold ``inference`` and ``block_height``, the newest
    value and its block: its id carries the block, its details too.
    Score and reward ids carry the five-minute bucket, so repeated reads of
    one bucket collapse at ingest.
    """
    bucket = F.floor(micros("at") / F.lit(BUCKET_S * MICRO)).cast("long").cast("string")
    who = [F.col("topic_id").cast("string"), F.col("address")]

    def made(kind: str, event_id: Column, value: Column, text: Column, more: Column) -> Column:
        return F.struct(event_id.alias("event_id"), F.lit(kind).alias("event_type"), value.alias("value_num"), text.alias("value_text"), more.alias("details_json"))

    def row(kind: str, value: Column, text: Column, bucketed: bool) -> Column:
        event_id = F.concat_ws(":", F.lit(SIGNAL_IDS[kind]), *who, *([bucket] if bucketed else []))
        return F.when(value.isNotNull(), made(kind, event_id, value, text, F.lit(None).cast("string")))

    def flag(name: str) -> tuple[Column, Column]:
        return F.col(name).cast("int").cast("double"), F.col(name).cast("string")

    def number(name: str) -> tuple[Column, Column]:
        return F.col(name).cast("double"), F.col(name).cast("string")

    inferences = []
    if "inference" in signals.columns:
        text, block = F.col("inference").cast("string"), F.col("block_height").cast("long")
        event_id = F.concat_ws(":", F.lit("latest_inference"), F.coalesce(block.cast("string"), F.lit("")), F.col("address"))
        more = F.to_json(F.struct(F.coalesce(block, F.lit(0)).alias("block_height")))
        inferences = [F.when(text.isNotNull(), made("inference", event_id, text.try_cast("double"), text, more))]
    rows = F.array(
        *inferences,
        row("score", *number("score"), True),
        row("reward", *number("reward_fraction"), True),
        row("whitelist", *flag("whitelisted"), False),
        row("eligibility", *flag("can_submit"), False),
    )
    out = signals.select(*TARGET, F.col("at").alias("observed_at"), F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("s"))
    return out.select(*TARGET, "s.*", F.lit("snapshot").alias("status"), "observed_at")


# ------------------------------------------------------------------ rollups
def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def counts(events: DataFrame, keys: Sequence[str] = (*TARGET, "deployment_id")) -> DataFrame:
    """Event counts and reward total per key, in one pass."""
    sub = _is("submission")
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events_total"),
        F.count_if(_is("inference")).alias("inference_count"),
        F.count_if(_is("reward")).alias("reward_count"),
        F.count_if(_is("score")).alias("score_count"),
        F.count_if(sub & (F.col("status") == "success")).alias("submission_success"),
        F.count_if(sub & (F.col("status") == "error")).alias("submission_error"),
        F.coalesce(F.sum(F.when(_is("reward"), F.col("value_num"))), F.lit(0.0)).alias("rewards_total"),
    )


def for_target(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of each target's own deployment; all rows where it has none."""
    own = targets.select(*TARGET, F.col("deployment_id").alias("_dep"))
    return events.join(own, TARGET).where(F.col("_dep").isNull() | (F.col("deployment_id") == F.col("_dep"))).drop("_dep")


def summary_counts(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts per registered target, zeros where it has no events."""
    per = counts(events)
    mine = for_target(per, targets)
    sums = [c for c in per.columns if c not in (*TARGET, "deployment_id")]
    total = mine.groupBy(*TARGET).agg(*[F.sum(c).alias(c) for c in sums])
    out = targets.select(*TARGET, "deployment_id").join(total, TARGET, "left")
    return out.na.fill(0, sums)


_SHOWN = ["observed_at", "value_text", "value_num", "tx_hash"]


def _newest(prefer: Column, order: Sequence[str]) -> Column:
    return F.max_by(F.struct(*_SHOWN), F.struct(prefer, *order))


def _sure() -> Column:
    """A value that is confirmed: success, with a hash, or not zero."""
    return F.coalesce((F.col("status") == "success") | F.col("tx_hash").isNotNull() | (F.col("value_num") != 0), F.lit(False))


def latest_inference(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Newest confirmed inference (success, with a hash, or non-zero), else the newest."""
    prefer = _sure().alias("sure")
    per = events.where(_is("inference")).groupBy(*TARGET, "deployment_id").agg(
        F.max_by(F.struct(F.struct(prefer, "observed_at", "event_id").alias("rank"), *_SHOWN), F.struct(prefer, "observed_at", "event_id")).alias("_v")
    )
    best = for_target(per, targets).groupBy(*TARGET).agg(F.max_by("_v", F.col("_v.rank")).alias("_v"))
    return best.select(*TARGET, *[F.col(f"_v.{c}").alias(c) for c in _SHOWN])


def latest_value(events: DataFrame, targets: DataFrame, kind: str) -> DataFrame:
    """Newest value of a kind in the target's deployment, else in any."""
    rank = F.struct("observed_at", "event_id")
    per = events.where(_is(kind)).groupBy(*TARGET, "deployment_id").agg(
        F.max_by(F.struct(rank.alias("rank"), *_SHOWN), rank).alias("_v")
    )
    own = targets.select(*TARGET, F.col("deployment_id").alias("_dep"))
    mine = F.coalesce(F.col("_dep").isNull() | (F.col("deployment_id") == F.col("_dep")), F.lit(False)).alias("mine")
    best = per.join(own, TARGET).groupBy(*TARGET).agg(F.max_by("_v", F.struct(mine, F.col("_v.rank"))).alias("_v"))
    return best.select(*TARGET, *[F.col(f"_v.{c}").alias(c) for c in _SHOWN])


PERIOD_SUMS = ["submission_success", "submission_error", "inference_count", "score_samples", "score_sum", "reward_fraction_samples", "reward_fraction_sum"]


def _by_period(rows: DataFrame, inside: Mapping[str, Column], n: Column, n_values: Column, values: Column) -> DataFrame:
    """Sums per (target, deployment, period) of rows that stand for ``n`` events each, in one pass."""

    def count(what: Column, size: Column) -> Column:
        return F.coalesce(F.sum(F.when(what, size)), F.lit(0)).cast("long")

    def total(what: Column) -> Column:
        return F.coalesce(F.sum(F.when(what, values)), F.lit(0.0))

    aggs = []
    for label, within in inside.items():
        sub, score, reward = (within & _is(kind) for kind in ("submission", "score", "reward"))
        made = [
            count(sub & (F.col("status") == "success"), n), count(sub & (F.col("status") == "error"), n), count(within & _is("inference"), n),
            count(score, n_values), total(score), count(reward, n_values), total(reward),
        ]
        aggs.append(F.struct(F.lit(label).alias("period"), *[c.alias(name) for c, name in zip(made, PERIOD_SUMS)]).alias(f"_p_{label}"))
    per = rows.groupBy(*TARGET, "deployment_id").agg(*aggs)
    return per.select(*TARGET, "deployment_id", F.explode(F.array(*[F.col(f"_p_{p}") for p in inside])).alias("m")).select(*TARGET, "deployment_id", "m.*")


def sums_of_periods(events: DataFrame, inside: Mapping[str, Column]) -> DataFrame:
    """Sums of the events that lie ``inside`` each period."""
    return _by_period(events, inside, F.lit(1), F.col("value_num").isNotNull().cast("long"), F.col("value_num"))


def period_report(sums: DataFrame, targets: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Sums per deployment (several rows each are added up) -> one row per target and period.

    A target whose deployment has no score or reward in any window falls back
    to all of its deployments.
    """
    names = PERIOD_SUMS
    own = targets.select(*TARGET, F.col("deployment_id").alias("_dep"))
    marked = sums.join(own, TARGET).withColumn("_mine", F.coalesce(F.col("_dep").isNull() | (F.col("deployment_id") == F.col("_dep")), F.lit(False)))
    mine = F.col("_mine")
    signal = F.sum(F.when(mine, F.col("score_samples") + F.col("reward_fraction_samples")).otherwise(0))
    # Both sums of every period in one aggregate: the choice between them needs all periods of the target.
    both = marked.groupBy(*TARGET, "period").agg(
        signal.alias("_signal"), F.struct(*[F.coalesce(F.sum(F.when(mine, F.col(n))), F.lit(0)).alias(n) for n in names]).alias("_own"),
        F.struct(*[F.sum(n).alias(n) for n in names]).alias("_any"),
    )
    every = both.groupBy(*TARGET).agg(F.sum("_signal").alias("_s"), F.collect_list(F.struct("period", "_own", "_any")).alias("_p"))
    used = every.select(*TARGET, "_s", F.explode("_p").alias("p")).select(
        *TARGET, "p.period", *[F.when(F.col("_s") == 0, F.col(f"p._any.{n}")).otherwise(F.col(f"p._own.{n}")).alias(n) for n in names]
    )
    grid = targets.select(*TARGET, F.explode(F.array(*[F.lit(p) for p in periods])).alias("period"))
    out = grid.join(used, [*TARGET, "period"], "left").na.fill(0, names)
    return out.select(
        *TARGET, "period", *[n for n in names if n != "score_sum"],
        div("score_sum", "score_samples").alias("score_avg"),
        div("reward_fraction_sum", "reward_fraction_samples").alias("reward_fraction_avg"),
    )


def period_metrics(events: DataFrame, targets: DataFrame, as_of: Column, periods: Mapping[str, int] = PERIODS) -> DataFrame:
    """Long form (topic, address, period, ...) of trailing-window metrics, from one scan of the log.

    ``sources.events.stored_period_metrics`` gives the same from partials.
    """
    now = micros(as_of)
    inside = {label: micros("observed_at") >= now - seconds * MICRO for label, seconds in periods.items()}
    # The bare column against a literal, so that the bound reaches the scan.
    kind = events.schema["observed_at"].dataType
    recent = events.where(F.col("observed_at") >= as_of.cast(kind) - F.expr(f"INTERVAL {max(periods.values())} SECONDS"))
    return period_report(sums_of_periods(recent, inside), targets, list(periods))


# Partial aggregates per hour, which syncs write and reports merge.
_NEWEST = ("observed_at", "event_id", "value_text", "value_num", "tx_hash")
PARTIAL = T.StructType(
    [
        *[f for f in EVENT_SCHEMA.fields if f.name in ("topic_id", "address", "deployment_id", "event_type", "status")],
        T.StructField("sure", T.BooleanType()),
        T.StructField("hour", T.TimestampNTZType()),
        T.StructField("n", T.LongType()),
        T.StructField("n_values", T.LongType()),
        T.StructField("value_sum", T.DoubleType()),
        T.StructField("newest", T.StructType([EVENT_SCHEMA[c] for c in _NEWEST])),
    ]
)


def partials(events: DataFrame) -> DataFrame:
    """Counts, sums and the newest row per target, deployment, kind, status, certainty and hour.

    All parts merge by adding or by taking the newest, so partials of disjoint
    sets of events can be put together in any order.
    """
    keys = [f.name for f in PARTIAL.fields[:6]]
    rows = events.withColumn("sure", _sure()).withColumn("hour", F.date_trunc("hour", "observed_at").cast("timestamp_ntz"))
    newest = F.struct(*[f.name for f in PARTIAL["newest"].dataType.fields])
    # The newest row begins with what it is chosen by.
    out = rows.groupBy(*keys, "hour").agg(
        F.count(F.lit(1)).alias("n"), F.count("value_num").alias("n_values"), F.coalesce(F.sum("value_num"), F.lit(0.0)).alias("value_sum"),
        F.max(newest).alias("newest"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PARTIAL.fields])


def sums_of_partials(rows: DataFrame, inside: Mapping[str, Column]) -> DataFrame:
    """As :func:`sums_of_periods`, from partials."""
    return _by_period(rows, inside, F.col("n"), F.col("n_values"), F.col("value_sum"))


def counts_of_partials(rows: DataFrame, keys: Sequence[str] = (*TARGET, "deployment_id")) -> DataFrame:
    """As :func:`counts`, from partials."""

    def count(what: Column) -> Column:
        return F.coalesce(F.sum(F.when(what, F.col("n"))), F.lit(0)).cast("long")

    sub = _is("submission")
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("events_total"), count(_is("inference")).alias("inference_count"), count(_is("reward")).alias("reward_count"),
        count(_is("score")).alias("score_count"), count(sub & (F.col("status") == "success")).alias("submission_success"),
        count(sub & (F.col("status") == "error")).alias("submission_error"),
        F.coalesce(F.sum(F.when(_is("reward"), F.col("value_sum"))), F.lit(0.0)).alias("rewards_total"),
    )


def latest_of_partials(rows: DataFrame, targets: DataFrame, kind: str) -> DataFrame:
    """As :func:`latest_inference` for inferences and :func:`latest_value` for other kinds, from partials."""
    own = targets.select(*TARGET, F.col("deployment_id").alias("_dep"))
    mine = F.coalesce(F.col("_dep").isNull() | (F.col("deployment_id") == F.col("_dep")), F.lit(False))
    marked = rows.where(_is(kind)).join(own, TARGET)
    if kind == "inference":
        marked, prefer = marked.where(mine), F.col("sure")
    else:
        prefer = mine
    best = marked.groupBy(*TARGET).agg(F.max_by("newest", F.struct(prefer.alias("p"), "newest.observed_at", "newest.event_id")).alias("_v"))
    return best.select(*TARGET, *[F.col(f"_v.{c}").alias(c) for c in _SHOWN])


def event_series(
    events: DataFrame, limit: int | None = 200, event_type: str | None = None, deployment_id: str | None = None,
    keys: Sequence[str] | None = TARGET, cell_s: int = MINUTE,
) -> DataFrame:
    """Newest events, at most ``limit`` per key (or in all, with ``keys=None``)."""
    from candlespark.sources.bars import newest_rows

    if event_type:
        events = events.where(_is(event_type))
    if deployment_id:
        events = events.where(F.col("deployment_id") == deployment_id)
    if limit is None:
        return events
    if keys is None:
        return events.orderBy(F.desc("observed_at"), F.desc("event_id")).limit(limit)
    return newest_rows(events, limit, keys, "observed_at", cell_s, ties=["event_id"])


def submission_timeline(events: DataFrame, slots: DataFrame, as_of: Column, max_slots: int = 25, deployment: bool = False) -> DataFrame:
    """Expected nonces (current - i * epoch) with the newest submission of each.

    ``slots`` holds (topic, address, current_nonce, epoch_length) and, with
    ``deployment``, ``deployment_id``: then only its events and those without
    a deployment count.
    """
    expected = slots.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_slots - 1))).alias("slot"))
    expected = expected.withColumn("nonce", F.col("current_nonce") - F.col("slot") * F.col("epoch_length"))
    expected = expected.withColumn("ts", add_seconds(as_of, -(F.col("slot") * F.col("epoch_length") * BLOCK_SECONDS).cast("long")))
    subs = details(events.where(_is("submission"))).where(F.col("nonce").isNotNull())
    if deployment:
        own = slots.select(*TARGET, F.col("deployment_id").alias("_dep"))
        subs = subs.join(own, TARGET).where(F.col("deployment_id").isNull() | (F.col("deployment_id") == F.col("_dep")))
    fields = ["observed_at", "status", "value_text", "tx_hash", "code", "extra_data"]
    newest = subs.groupBy(*TARGET, "nonce").agg(F.max_by(F.struct(*fields), F.struct("observed_at", "event_id")).alias("_s"))
    hit = F.col("_s")
    status = F.when(hit.isNull(), "missed").when(F.col("_s.status") == "success", "success").otherwise("error")
    return expected.join(newest, [*TARGET, "nonce"], "left").select(
        *TARGET, "slot", "nonce", "ts", status.alias("status"), F.col("_s.observed_at").alias("observed_at"),
        F.col("_s.value_text").alias("value_text"), F.col("_s.tx_hash").alias("tx_hash"), F.col("_s.code").alias("code"),
        F.col("_s.extra_data").alias("extra_data"),
    )


# --------------------------------------------------------------- registries
def merge_targets(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert new targets; a known one only takes a new deployment id.

    ``changes`` may hold ``enabled`` to switch targets on and off.
    """
    keys = TARGET
    flag = "enabled" in changes.columns
    old = current.select(*keys, F.col("deployed_at").alias("_od"), F.col("deployment_id").alias("_oi"), F.col("enabled").alias("_oe"))
    new = changes.select(*keys, F.col("deployed_at").alias("_nd"), F.col("deployment_id").alias("_ni"),
                         (F.col("enabled") if flag else F.lit(None).cast("boolean")).alias("_ne"))
    return old.join(new, keys, "full").select(
        *keys, F.coalesce("_od", "_nd").alias("deployed_at"), F.coalesce("_ni", "_oi").alias("deployment_id"),
        F.coalesce("_ne", "_oe", F.lit(True)).alias("enabled"),
    )


def enabled_targets(targets: DataFrame) -> DataFrame:
    return targets.where("enabled").orderBy(*TARGET)


def deployment_history(deployments: DataFrame) -> DataFrame:
    """(topic, address, deployment_id, deployed_at) -> with ended_at and is_active."""

    def columns(d, w):
        return d.withColumn("ended_at", F.lead("deployed_at").over(w))

    out = over_blocks(deployments, TARGET, "deployed_at", 0, 1, columns, ties=["deployment_id"], cell_s=30 * DAY)
    return out.withColumn("is_active", F.col("ended_at").isNull())


def active_deployments(targets: DataFrame, history: DataFrame) -> DataFrame:
    active = history.where("is_active").select(*TARGET, F.col("deployment_id").alias("active_deployment"), F.col("deployed_at").alias("active_since"))
    return targets.join(active, TARGET)


def events_to_deployments(events: DataFrame, history: DataFrame, cell_s: int = MINUTE) -> DataFrame:
    """Each event with the deployment that was active at its time."""
    spans = history.select(*TARGET, F.col("deployment_id").alias("active_deployment"), F.col("deployed_at").alias("start"), "ended_at")
    return interval_join(events, spans, TARGET, "observed_at", "start", "ended_at", cell_s)


def health(status: Column, last_error: Column) -> Column:
    clean = last_error.isNull() | (last_error == "")
    return F.when((status == "running") & clean, "good").when(status == "crashed", "bad").otherwise("degraded")


def address_rollup(workers: DataFrame) -> DataFrame:
    """Per address: running and total workers, and the workers by topic."""
    h = health(F.col("status"), F.col("last_error"))
    item = F.struct("topic_id", "status", h.alias("health"))
    return workers.groupBy("address").agg(
        F.count_if(F.col("status") == "running").alias("running"),
        F.count(F.lit(1)).alias("total"),
        F.sort_array(F.collect_list(item)).alias("workers"),
    )
