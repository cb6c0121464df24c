"""Bar store, landing jobs, catalogue filters, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlespark.functions import names as N
from candlespark.operators import quality as Q
from candlespark.operators.asof import alignment
from candlespark.operators.features import rolling
from candlespark.plans.feature_queries import OHLC, W, _as_of, last
from candlespark.plans.registry import query, r
from candlespark.plans.tables import BARS, BARS_1D, MONTH, TICKS, bars_1d, bars_1h, table, ticks
from candlespark.session import remove_dir, shared_dir
from candlespark.sources import bars as B
from candlespark.sources import damage as D
from candlespark.sources import exports as E
from candlespark.sources import payloads as P
from candlespark.sources import snapshots


# ------------------------------------------------------------ store and scan
@query("scan_bars_range", f"""
WITH {BARS} SELECT symbol, open_time, {r(*OHLC)}, n_trades FROM bars
WHERE symbol IN ('click', 'view') AND open_time >= TIMESTAMP '2024-01-05' AND open_time <= TIMESTAMP '2024-01-20 12:00:00'""")
def _(spark, sf):
    """Write the bars to a store, read two symbols and a time range back."""
    path = shared_dir(spark, "store")
    B.upsert_bars(bars_1h(spark, sf), path, "ticks")
    out = B.scan_bars(spark, path, ["click", "view"], "2024-01-05", "2024-01-20 12:00:00")
    return out.select(*B.BAR_COLUMNS)


@query("upsert_merges_versions", f"""
WITH {BARS}, v AS (SELECT symbol, open_time, close, volume, 1 AS seq FROM bars
  UNION ALL SELECT symbol, open_time, close + 1, volume, 2 FROM bars WHERE open_time >= TIMESTAMP '2024-01-15'
  UNION ALL SELECT symbol, open_time + INTERVAL 30 DAY, close, volume, 2 FROM bars)
SELECT symbol, open_time, {r('arg_max(close, seq) AS close', 'arg_max(volume, seq) AS volume')} FROM v GROUP BY 1, 2""")
def _(spark, sf):
    """A later batch replaces bars of touched days and adds new days."""
    path, bars = shared_dir(spark, "store"), bars_1h(spark, sf)
    B.upsert_bars(bars, path, "ticks", seq=1)
    changed = bars.where("open_time >= TIMESTAMP_NTZ '2024-01-15 00:00:00'").withColumn("close", F.col("close") + 1)
    added = bars.withColumn("open_time", F.col("open_time") + F.expr("INTERVAL 30 DAYS"))
    B.upsert_bars(changed.unionByName(added), path, "ticks", seq=2)
    return B.scan_bars(spark, path).select("symbol", "open_time", "close", "volume")


@query("upsert_tied_versions", f"""
WITH {BARS} SELECT symbol, open_time, {r("close + CASE WHEN open_time < TIMESTAMP '2024-01-10' THEN 2 ELSE 1 END AS close")} FROM bars""")
def _(spark, sf):
    """Batches without a version number: the later one wins; copies within a batch: the one of more trades, then the larger."""
    path, bars = shared_dir(spark, "store"), bars_1h(spark, sf)
    B.upsert_bars(bars, path, "ticks")
    B.upsert_bars(bars.unionByName(bars.withColumn("close", F.col("close") + 1)), path, "ticks")
    B.upsert_bars(bars.where("open_time < TIMESTAMP_NTZ '2024-01-10 00:00:00'").withColumn("close", F.col("close") + 2), path, "ticks")
    return B.scan_bars(spark, path).select("symbol", "open_time", "close")


SNAPSHOT_VERSIONS = """v AS (SELECT symbol, open_time, close, 1 AS seq FROM bars
  UNION ALL SELECT symbol, open_time, close + 1, 2 FROM bars WHERE open_time >= TIMESTAMP '2024-01-15'
  UNION ALL SELECT symbol, open_time + INTERVAL 30 DAY, close + 2, 4 FROM bars)"""


def snapshot_store(spark, sf):
    """A table of three upserts, the second followed by a compaction."""
    path, bars = shared_dir(spark, "snapshots"), bars_1h(spark, sf)
    snapshots.upsert(bars, path, "ticks")
    snapshots.upsert(bars.where("open_time >= TIMESTAMP_NTZ '2024-01-15 00:00:00'").withColumn("close", F.col("close") + 1), path, "ticks")
    snapshots.compact(spark, path)
    later = bars.withColumn("open_time", F.col("open_time") + F.expr("INTERVAL 30 DAYS")).withColumn("close", F.col("close") + 2)
    snapshots.upsert(later, path, "ticks")
    return path


@query("snapshot_store_rows", f"""
WITH {BARS}, {SNAPSHOT_VERSIONS}
SELECT symbol, open_time, max(seq)::BIGINT AS version, {r('arg_max(close, seq) AS close')} FROM v GROUP BY 1, 2""")
def _(spark, sf):
    """Bars merged on read from immutable commits; the compaction keeps the version of each bar."""
    return snapshots.scan(spark, snapshot_store(spark, sf)).select("symbol", "open_time", F.col("ingested_at").alias("version"), "close")


@query("snapshot_store_history", f"""
WITH {BARS}, {SNAPSHOT_VERSIONS}, points AS (SELECT unnest([1, 2, 3, 4]) AS version),
  seen AS (SELECT version, symbol, open_time, arg_max(close, seq) AS close FROM points JOIN v ON seq <= version GROUP BY ALL)
SELECT version, symbol, count(*) AS n_bars, {r('sum(close) AS close_total')} FROM seen GROUP BY 1, 2""")
def _(spark, sf):
    """What a reader of each version of the table sees, the compaction (version 3) included."""
    path = snapshot_store(spark, sf)
    seen = [snapshots.scan(spark, path, at=v).withColumn("version", F.lit(v)) for v in (1, 2, 3, 4)]
    rows = seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(seen[3])
    return rows.groupBy("version", "symbol").agg(F.count("*").alias("n_bars"), F.sum("close").alias("close_total"))


@query("sources_kept_apart", f"""
WITH {BARS}, b2 AS (SELECT 'a' AS source, symbol, open_time, close FROM bars UNION ALL SELECT 'b', symbol, open_time, close * 2 FROM bars)
SELECT source, symbol, count(*) AS n_bars, {r('sum(close) AS close_total')} FROM b2 GROUP BY ALL""")
def _(spark, sf):
    """Two sources of the same symbols live in one store and do not mix."""
    path, bars = shared_dir(spark, "store"), bars_1h(spark, sf)
    B.upsert_bars(bars, path, "a", seq=1)
    B.upsert_bars(bars.withColumn("close", F.col("close") * 2), path, "b")
    out = B.scan_bars(spark, path)
    return out.groupBy("source", "symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.sum("close").alias("close_total"))


@query("dedupe_keep_last", f"""
WITH {TICKS} SELECT symbol, date_trunc('minute', ts)::TIMESTAMP AS open_time, round(arg_max(price, seq), 6) + 0.0 AS price, max(seq) AS ingested_at
FROM ticks GROUP BY 1, 2""")
def _(spark, sf):
    """Newest version per (symbol, minute)."""
    rows = ticks(spark, sf).select(
        "symbol", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("open_time"), "price", F.col("seq").alias("ingested_at")
    )
    return B.dedupe(rows)


@query("latest_per_symbol", f"WITH {BARS} SELECT symbol, max(open_time) AS last_time FROM bars GROUP BY 1")
def _(spark, sf):
    """Newest bar time per symbol."""
    return B.latest(bars_1h(spark, sf))


@query("hot_cache_rows", f"""
WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM bars)
SELECT symbol, open_time, {r('close')} FROM k WHERE k <= 50""")
def _(spark, sf):
    """The last 50 bars per symbol, ordering only the days that can hold them."""
    return B.newest_rows(bars_1h(spark, sf), 50).select("symbol", "open_time", "close")


@query("restrict_days", f"""
WITH {BARS}, d AS (SELECT DISTINCT o_orderdate::DATE - DATE '1995-01-01' + DATE '2024-01-01' AS dt FROM orders
  WHERE o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '1995-02-01')
SELECT symbol, open_time, {r('close')} FROM bars WHERE open_time::DATE IN (SELECT dt FROM d)""".replace(
    "o_orderdate::DATE - DATE '1995-01-01' + DATE '2024-01-01'", "DATE '2024-01-01' + (o_orderdate::DATE - DATE '1995-01-01')::INTEGER"))
def _(spark, sf):
    """Bars of a set of days given as a table."""
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP_NTZ '1995-02-01 00:00:00'")
    shift = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    days = o.select(F.date_add(F.lit("2024-01-01").cast("date"), shift).alias("dt"))
    return B.restrict_days(bars_1h(spark, sf), days).select("symbol", "open_time", "close")


@query("landed_klines", f"""
WITH {BARS} SELECT symbol, open_time, {r(*OHLC)}, n_trades FROM bars""")
def _(spark, sf):
    """Bars written out as candle-array payloads, one per symbol and day, and landed again."""
    b = bars_1h(spark, sf)
    ms = F.unix_millis(F.col("open_time").cast("timestamp")).cast("string")
    plain = [F.concat(F.lit('"'), F.regexp_replace(F.format_number(F.col(c), 6), ",", ""), F.lit('"')) for c in OHLC]
    o, h, lo, c, v, qv = plain
    zero = F.lit('"0"')
    kline = F.concat(F.lit("["), F.concat_ws(",", ms, o, h, lo, c, v, ms, qv, F.col("n_trades").cast("string"), zero, zero, zero), F.lit("]"))
    payload = b.groupBy("symbol", F.to_date("open_time").alias("d")).agg(F.collect_list(kline).alias("k"))
    payload = payload.select("symbol", F.concat(F.lit("["), F.array_join("k", ","), F.lit("]")).alias("payload"))
    return P.land_klines(payload)


@query("landed_rows", f"""
WITH {BARS} SELECT symbol, open_time, {r('open', 'high', 'low', 'close', 'CASE WHEN n_trades > 1 THEN volume ELSE 0 END AS volume')},
  NULL::DOUBLE AS quote_volume, 0::BIGINT AS n_trades FROM bars""")
def _(spark, sf):
    """Nested and flat row payloads; a missing volume is read as 0."""
    b = bars_1h(spark, sf)
    stamp = F.date_format("open_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    volume = F.when(F.col("n_trades") > 1, F.col("volume")).alias("volume")
    nested = F.to_json(F.struct(stamp, F.struct(*prices, volume).alias("values")))
    flat = F.to_json(F.struct(stamp, *prices, volume))
    return P.land_rows(b.select("symbol", F.when(F.hour("open_time") < 12, nested).otherwise(flat).alias("payload")))


@query("clean_bars", f"""
WITH {BARS} SELECT symbol, open_time, {r('CASE WHEN n_trades = 1 THEN 0 ELSE volume END AS volume', 'close')} FROM bars WHERE hour(open_time) <> 3""")
def _(spark, sf):
    """NaN prices dropped, NaN volume read as 0."""
    nan = F.lit(float("nan"))
    b = bars_1h(spark, sf)
    b = b.withColumn("close", F.when(F.hour("open_time") == 3, nan).otherwise(F.col("close")))
    b = b.withColumn("volume", F.when(F.col("n_trades") == 1, nan).otherwise(F.col("volume")))
    return P.clean(b).select("symbol", "open_time", "volume", "close")


@query("symbol_keys", """
SELECT p_partkey, regexp_replace(p_brand || '/' || p_type || ' -' || p_name, '[/\\\\:\\- ]', '', 'g') AS symbol_key,
  replace(replace(lower(p_brand || '/' || p_type || ' -' || p_name), '/', ''), '-', '') AS ticker FROM part""")
def _(spark, sf):
    """Path and catalogue forms of symbol names."""
    name = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit(" -"), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", N.symbol_key(name).alias("symbol_key"), N.ticker(name).alias("ticker"))


@query("tolerant_scan", f"WITH {BARS} SELECT symbol, count(*) AS n_bars, {r('sum(close) AS close_total')}, true AS reported FROM bars GROUP BY 1")
def _(spark, sf):
    """A store with a broken file: the rest is read, the file is reported."""
    path, bars = shared_dir(spark, "store"), bars_1h(spark, sf)
    bars.select(*B.BAR_COLUMNS).write.parquet(f"{path}/good")
    bars.select(F.concat_ws(",", "symbol", F.col("close").cast("string"))).write.text(f"{path}/broken")
    n_bad = B.unreadable_files(spark, path).count()
    out = B.tolerant_scan(spark, path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.sum("close").alias("close_total"))
    return out.withColumn("reported", F.lit(n_bad > 0))


def _with_broken_page(spark, path, out):
    """Copies of all files below ``path`` in a folder beside it, named with ``out``: each has its footer, but a page with other bytes."""

    def spoil(batches):
        for batch in batches:
            for item in batch.to_pylist():
                fs, name = D.located(item["path"])
                folder, _, file = name.rpartition("/")
                fs.create_dir(f"{folder}-{out}")
                with fs.open_input_stream(name) as src, fs.open_output_stream(f"{folder}-{out}/{file}") as dst:
                    dst.write(src.read(item["length"] // 3))
                    dst.write(bytes(255 - b for b in src.read(64)))
                    while chunk := src.read(1 << 20):
                        dst.write(chunk)
            yield batch

    D.stored_files(spark, path).mapInArrow(spoil, "path string, length long").write.format("noop").mode("overwrite").save()


@query("damaged_row_groups", f"""
WITH {BARS} SELECT symbol, count(*) AS n_bars, {r('sum(close) AS close_total')}, 'read' AS state FROM bars WHERE symbol <> 'click' GROUP BY 1
UNION ALL SELECT NULL, count(*), NULL, 'row group 0 damaged' FROM bars WHERE symbol = 'click'""")
def _(spark, sf):
    """A store with a valid empty file and one whose page is damaged: the rows of all others, and where rows are lost."""
    path, bars = shared_dir(spark, "store"), bars_1h(spark, sf).select(*B.BAR_COLUMNS)
    bars.where("symbol <> 'click'").write.parquet(f"{path}/store/good")
    bars.where("false").coalesce(1).write.parquet(f"{path}/store/empty")
    bars.where("symbol = 'click'").repartition(1).write.parquet(f"{path}/store/click")
    _with_broken_page(spark, f"{path}/store/click", "damaged")
    remove_dir(spark, f"{path}/store/click")
    whole = D.intact_rows(spark, f"{path}/store").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"), F.sum("close").alias("close_total"), F.lit("read").alias("state"))
    where = F.concat(F.lit("row group "), F.col("row_group"), F.lit(" damaged"))
    lost = D.damaged_parts(spark, f"{path}/store").select(
        F.lit(None).cast("string").alias("symbol"), F.col("n_rows").alias("n_bars"), F.lit(None).cast("double").alias("close_total"), where.alias("state"))
    return whole.unionByName(lost)


@query("exported_predictions", f"""
WITH {BARS}, p AS (SELECT symbol, open_time, ln(lead(close) OVER w) - ln(close) AS target, -0.3 * (ln(close) - ln(lag(close) OVER w)) AS pred FROM bars {W})
SELECT open_time, {r('target', 'pred')} FROM p WHERE pred IS NOT NULL""")
def _(spark, sf):
    """Predictions written as CSV and read back."""
    from candlespark.functions.safe import ln

    def columns(d, w):
        return d.withColumn("target", ln(F.lead("close").over(w)) - ln("close")).withColumn(
            "pred", F.lit(-0.3) * (ln("close") - ln(F.lag("close").over(w)))
        )

    path = shared_dir(spark, "predictions")
    E.export_predictions(rolling(bars_1h(spark, sf), 1, columns, after=1, cell_s=MONTH), path)
    return spark.read.schema("open_time TIMESTAMP_NTZ, target DOUBLE, pred DOUBLE").option("header", "true").csv(path)


@query("exported_runs", f"""
WITH {BARS} SELECT symbol, count(*) AS n, round(avg(close), 6) + 0.0 AS mean_close FROM bars GROUP BY 1""")
def _(spark, sf):
    """Run records written as JSON lines and read back."""
    runs = bars_1h(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean_close"))
    path = shared_dir(spark, "runs")
    E.export_runs(runs, ["symbol"], ["n", "mean_close"], path)
    back = spark.read.schema("config STRUCT<symbol: STRING>, metrics STRUCT<n: BIGINT, mean_close: DOUBLE>").json(path)
    return back.select("config.symbol", "metrics.n", "metrics.mean_close")


# ------------------------------------------------------- catalogue and guards
CAT = """c AS (SELECT p_partkey AS id, p_name AS name, p_type AS description, p_brand AS src, CASE WHEN p_size <= 25 THEN '1min' ELSE '1h' END AS freq,
  CASE WHEN p_type = 'ECONOMY' THEN 'Price of ' WHEN p_type = 'LARGE' THEN 'Log Return of ' ELSE 'log price ' END || p_name AS metadata_text FROM part)"""


def _catalogue(spark, sf):
    p = table(spark, sf, "part")
    text = F.when(F.col("p_type") == "ECONOMY", "Price of ").when(F.col("p_type") == "LARGE", "Log Return of ").otherwise("log price ")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"),
        F.struct(F.col("p_brand").alias("source"), F.when(F.col("p_size") <= 25, "1min").otherwise("1h").alias("frequency")).alias("metadata"),
        F.concat(text, "p_name").alias("metadata_text"),
    )


@query("price_topics", f"WITH {CAT} SELECT id, metadata_text FROM c WHERE lower(metadata_text) LIKE '%price%' AND lower(metadata_text) NOT LIKE '%log%'")
def _(spark, sf):
    """Topics about prices."""
    return N.price_topics(_catalogue(spark, sf), "metadata_text").select("id", "metadata_text")


@query("return_topics", f"WITH {CAT} SELECT id, metadata_text FROM c WHERE lower(metadata_text) LIKE '%log%' AND lower(metadata_text) LIKE '%return%'")
def _(spark, sf):
    """Topics about log returns."""
    return N.return_topics(_catalogue(spark, sf), "metadata_text").select("id", "metadata_text")


@query("dataset_filter", f"WITH {CAT} SELECT id, name FROM c WHERE src = 'Brand#2' AND freq = '1min'")
def _(spark, sf):
    """Catalogue entries of one source and frequency."""
    return N.datasets(_catalogue(spark, sf), "Brand#2", "1min").select("id", "name")


@query("dataset_search", f"WITH {CAT} SELECT id, name, description FROM c WHERE lower(name) LIKE '%ring%' OR lower(description) LIKE '%ring%'")
def _(spark, sf):
    """Free-text search over name and description."""
    return N.search(_catalogue(spark, sf), "Ring").select("id", "name", "description")


@query("prediction_guard", f"""
WITH {TICKS}, p AS (SELECT symbol, CASE WHEN size = 0 THEN 'NaN'::DOUBLE WHEN size = 1 THEN 'Infinity'::DOUBLE WHEN size = 2 THEN 0 ELSE price END AS v FROM ticks)
SELECT symbol, count(*) FILTER (WHERE isfinite(v)) AS n_finite, count(*) FILTER (WHERE isfinite(v) AND v <> 0) AS n_usable,
  count(*) FILTER (WHERE NOT isfinite(v)) AS n_quarantined FROM p GROUP BY 1""")
def _(spark, sf):
    """Predictions that are no finite (non-zero) numbers are set apart."""
    size = F.col("size")
    v = F.when(size == 0, float("nan")).when(size == 1, float("inf")).when(size == 2, 0.0).otherwise(F.col("price"))
    d = ticks(spark, sf).select("symbol", v.alias("v"))
    return d.groupBy("symbol").agg(
        F.count_if(N.valid_prediction("v")).alias("n_finite"), F.count_if(N.valid_prediction("v", allow_zero=False)).alias("n_usable"),
        F.count_if(~N.valid_prediction("v")).alias("n_quarantined"),
    )


@query("price_from_log_return", f"""
WITH {BARS} SELECT symbol, open_time, round(CASE WHEN close - 30 > 0 THEN (close - 30) * exp(ln(close / open)) END, 6) + 0.0 AS price FROM bars""")
def _(spark, sf):
    """Price from a log return; NULL for a price that is not positive."""
    out = N.price_from_log_return(F.col("close") - 30, F.ln(F.col("close") / F.col("open")))
    return bars_1h(spark, sf).select("symbol", "open_time", out.alias("price"))


# -------------------------------------------------------------- data quality
@query("day_counts", f"WITH {BARS} SELECT symbol, open_time::DATE AS dt, count(*) AS n_bars FROM bars GROUP BY ALL")
def _(spark, sf):
    """Bars per symbol and day."""
    return Q.day_counts(bars_1h(spark, sf))


DAYS = BARS + ", dc AS (SELECT symbol, open_time::DATE AS dt, count(*) AS n_bars FROM bars GROUP BY ALL)"


@query("complete_days", f"WITH {DAYS} SELECT * FROM dc WHERE n_bars = 24")
def _(spark, sf):
    """Days with all 24 hours."""
    return Q.complete_days(bars_1h(spark, sf), 24)


MISSING = DAYS + """, lastd AS (SELECT symbol, max(dt) AS ld FROM dc GROUP BY 1),
cal AS (SELECT symbol, unnest(generate_series(TIMESTAMP '2023-12-20', (ld - 1)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS dt FROM lastd),
miss AS (SELECT cal.* FROM cal LEFT JOIN (SELECT * FROM dc WHERE n_bars = 24) k USING (symbol, dt) WHERE k.symbol IS NULL)"""


@query("incomplete_days", f"WITH {MISSING} SELECT symbol, dt FROM miss")
def _(spark, sf):
    """Days that miss bars, days without any bar included."""
    return Q.incomplete_days(bars_1h(spark, sf), "2023-12-20", 24)


@query("backfill_plan", f"""
WITH {MISSING}, nw AS (SELECT max(ts) AS t FROM events),
mo AS (SELECT symbol, date_trunc('month', dt)::DATE AS m, list_sort(list(dt)) AS ds FROM miss GROUP BY 1, 2),
dd AS (SELECT symbol, 'day' AS kind, d::TIMESTAMP AS from_time, d::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS to_time, 1 AS n_days
  FROM (SELECT symbol, unnest(ds) AS d FROM mo WHERE len(ds) <= 7)),
mm AS (SELECT symbol, 'month' AS kind, m::TIMESTAMP AS from_time, m::TIMESTAMP + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS to_time, len(ds) AS n_days FROM mo WHERE len(ds) > 7),
tl AS (SELECT symbol, 'tail' AS kind, max(open_time) + INTERVAL 1 MILLISECOND AS from_time, max(t) AS to_time, 0 AS n_days FROM bars, nw GROUP BY 1)
SELECT symbol, kind, from_time, to_time, n_days::INTEGER AS n_days FROM (SELECT * FROM dd UNION ALL SELECT * FROM mm UNION ALL SELECT * FROM tl)""")
def _(spark, sf):
    """Requests that complete each history: days, whole months, tail."""
    plan = Q.backfill_plan(bars_1h(spark, sf), "2023-12-20", _as_of(spark, sf), 24)
    return plan.select("symbol", "kind", "from_time", "to_time", F.size("days").alias("n_days"))


@query("backfill_first_requests", """
SELECT DISTINCT o_orderpriority AS symbol, 'full' AS kind, TIMESTAMP '2023-12-20' AS from_time, (SELECT max(ts) FROM events) AS to_time, 0::INTEGER AS n_days FROM orders
WHERE o_orderpriority NOT IN (SELECT event_type FROM events)""")
def _(spark, sf):
    """Whole-history requests for wanted symbols without any bar: the daily symbols have none at one hour."""
    wanted = bars_1d(spark, sf).select("symbol").unionByName(bars_1h(spark, sf).select("symbol")).distinct()
    plan = Q.first_request(wanted, bars_1h(spark, sf), "2023-12-20", _as_of(spark, sf))
    return plan.select("symbol", "kind", "from_time", "to_time", F.size("days").alias("n_days"))


@query("registered_source_bars", f"""
WITH {BARS} SELECT symbol, open_time, {r('close', 'volume')} FROM bars
WHERE symbol IN ('click', 'view') AND open_time >= TIMESTAMP '2024-01-08' AND open_time <= TIMESTAMP '2024-01-25'""")
def _(spark, sf):
    """A user's bar source by name: two overlapping ranges fetched and merged into the store."""
    from candlespark.sources.registry import register_source, sync_source

    register_source("hourly", lambda spark, symbols, start, end: bars_1h(spark, sf).withColumnRenamed("n_trades", "trades_done"))
    path = shared_dir(spark, "store")
    for span in (("2024-01-08", "2024-01-18"), ("2024-01-15", "2024-01-25")):
        sync_source(spark, "hourly", path, ["click", "view"], *span)
    return B.scan_bars(spark, path, source="hourly").select("symbol", "open_time", "close", "volume")


@query("chunk_ranges", f"""
WITH {BARS_1D}, sp AS (SELECT symbol, min(open_time) AS lo, max(open_time) AS hi FROM bars GROUP BY 1),
s AS (SELECT symbol, hi, unnest(generate_series(lo, hi, INTERVAL '30 days 1 second')) AS chunk_start FROM sp)
SELECT symbol, chunk_start, least(chunk_start + INTERVAL 30 DAY, hi) AS chunk_end FROM s WHERE chunk_start < hi""")
def _(spark, sf):
    """Long ranges cut into chunks of 30 days."""
    span = bars_1d(spark, sf).groupBy("symbol").agg(F.min("open_time").alias("from_time"), F.max("open_time").alias("to_time"))
    return Q.chunk_ranges(span, 30).select("symbol", "chunk_start", "chunk_end")


@query("resume_points", f"""
WITH {BARS}, wanted AS (SELECT DISTINCT event_type AS symbol FROM events UNION SELECT DISTINCT o_orderpriority FROM orders)
SELECT w.symbol, coalesce(max(b.open_time) - INTERVAL 1 HOUR, TIMESTAMP '2020-01-01') AS resume_at FROM wanted w LEFT JOIN bars b USING (symbol) GROUP BY 1""")
def _(spark, sf):
    """Where ingestion continues, per wanted symbol."""
    wanted = table(spark, sf, "events").select(F.col("event_type").alias("symbol")).union(
        table(spark, sf, "orders").select("o_orderpriority")).distinct()
    return Q.resume_points(wanted, bars_1h(spark, sf), 3600)


@query("bar_gaps", f"""
WITH {BARS} SELECT symbol, open_time, round(epoch(open_time) - epoch(lag(open_time) OVER w), 6) + 0.0 AS gap_s FROM bars {W}""")
def _(spark, sf):
    """Seconds since the previous bar."""
    return Q.gaps(bars_1h(spark, sf), cell_s=MONTH)


@query("resolution_audit", f"""
WITH {BARS}, nw AS (SELECT max(ts) AS t FROM events), g AS (SELECT symbol, open_time, epoch(open_time) - epoch(lag(open_time) OVER w) AS gap FROM bars {W}),
k AS (SELECT symbol, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL),
u AS (SELECT symbol, first(gap ORDER BY n DESC, gap) AS us, max(gap) AS ls, min(gap) > 0 AS inc FROM k GROUP BY 1),
s AS (SELECT symbol, count(*) AS n_bars, min(open_time) AS lo, max(open_time) AS hi FROM bars GROUP BY 1),
e AS (SELECT *, (floor((epoch(hi) - epoch(lo)) / 3600) + 1)::BIGINT AS n_expected, (epoch_us(t) - epoch_us(hi)) / 60e6 AS lag_m FROM s, nw)
SELECT symbol, n_bars, n_expected, {r('n_bars / n_expected AS coverage', 'lag_m AS lag_minutes', 'us AS usual_step_s', 'ls AS largest_step_s')},
  inc AS increasing, n_bars / n_expected >= 0.85 AND lag_m <= 15 AS usable FROM e JOIN u USING (symbol)""")
def _(spark, sf):
    """Usual step, coverage and lag per symbol."""
    return Q.resolution_audit(bars_1h(spark, sf), 3600, _as_of(spark, sf), cell_s=MONTH)


def _profile_sql(c: str) -> list[str]:
    m = f"avg({c})"
    return [
        f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}_null_rate", f"{m} AS {c}_mean", f"stddev_pop({c}) AS {c}_std",
        f"(avg({c} ** 3) - 3 * {m} * avg({c} ** 2) + 2 * {m} ** 3) / stddev_pop({c}) ** 3 AS {c}_skew",
        f"(avg({c} ** 4) - 4 * {m} * avg({c} ** 3) + 6 * {m} ** 2 * avg({c} ** 2) - 3 * {m} ** 4) / var_pop({c}) ** 2 - 3 AS {c}_kurtosis",
        f"min({c}) AS {c}_min", f"max({c}) AS {c}_max",
    ]


@query("bar_profile", f"""
WITH {BARS} SELECT symbol, count(*) AS n_rows, min(open_time) AS first_time, max(open_time) AS last_time, {r(*_profile_sql('close'), *_profile_sql('volume'), digits=5)}
FROM bars GROUP BY 1""", digits=5)
def _(spark, sf):
    """Date range, null rates and distribution shape."""
    return Q.profile(bars_1h(spark, sf), ["close", "volume"])


@query("bar_quantiles", f"""
WITH {BARS} SELECT symbol, {r(*[f"quantile_disc(close, {s}) AS q{round(s * 100)}" for s in (0.25, 0.5, 0.75)])} FROM bars GROUP BY 1""")
def _(spark, sf):
    """Quartiles of the close."""
    return Q.quantiles(bars_1h(spark, sf), "close", [0.25, 0.5, 0.75])


@query("autocorrelation_profile", f"""
WITH {BARS}, s AS (SELECT symbol, open_time, ln(close) - ln(lag(close) OVER w) AS r FROM bars {W}),
l AS (SELECT symbol, r, unnest([1, 2, 6, 24]) AS lag, unnest([lag(r, 1) OVER w, lag(r, 2) OVER w, lag(r, 6) OVER w, lag(r, 24) OVER w]) AS p FROM s {W})
SELECT symbol, lag::INTEGER AS lag, round(corr(r, p), 6) + 0.0 AS autocorr, count(*) AS n FROM l WHERE r IS NOT NULL AND p IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    """Autocorrelation of the log steps at several lags."""
    from candlespark.operators.features import log_step

    steps = rolling(bars_1h(spark, sf).select("symbol", "open_time", "close"), 1, lambda d, w: d.withColumn("r", log_step(w)), cell_s=MONTH)
    return Q.autocorrelation(steps, "r", [1, 2, 6, 24], cell_s=MONTH)


@query("rolling_stationarity", f"""
WITH {BARS} SELECT symbol, open_time, {r(f"avg(close) OVER {last(48)} AS mean_48", f"stddev_pop(close) OVER {last(48)} AS std_48", digits=8)} FROM bars""", digits=8)
def _(spark, sf):
    """Rolling mean and deviation over 48 bars."""
    from candlespark.operators.features import last_rows

    def columns(d, w):
        f = last_rows(w, 48)
        return d.withColumn("mean_48", F.avg("close").over(f)).withColumn("std_48", F.stddev_pop("close").over(f))

    return rolling(bars_1h(spark, sf), 47, columns, cell_s=MONTH).select("symbol", "open_time", "mean_48", "std_48")


@query("source_alignment", f"""
WITH {BARS}, sh AS (SELECT unnest([-1, 0, 1]) AS shift), a AS (SELECT symbol, shift, open_time FROM bars, sh WHERE n_trades > 1),
b AS (SELECT symbol, shift, open_time + shift * INTERVAL 1 HOUR AS open_time FROM bars, sh WHERE volume > 0)
SELECT symbol, shift::INTEGER AS shift, count(*) FILTER (WHERE ta IS NOT NULL AND tb IS NOT NULL) AS matched, count(*) FILTER (WHERE tb IS NULL) AS only_a,
  count(*) FILTER (WHERE ta IS NULL) AS only_b
FROM (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.shift, b.shift) AS shift, a.open_time AS ta, b.open_time AS tb
  FROM a FULL JOIN b ON a.symbol = b.symbol AND a.shift = b.shift AND a.open_time = b.open_time) GROUP BY ALL""")
def _(spark, sf):
    """Do two sources share their time base?  Matches at shifts -1, 0, +1."""
    bars = bars_1h(spark, sf)
    # One source lacks the hours of a single trade, the other those without volume.
    return alignment(bars.where("n_trades > 1"), bars.where("volume > 0"), ["symbol"], "open_time", 3600)


@query("price_sanity", f"""
WITH {BARS} SELECT symbol, count(*) AS n_bars, count(*) FILTER (WHERE low > open OR low > close) AS low_above, count(*) FILTER (WHERE high < open OR high < close) AS high_below,
  count(*) FILTER (WHERE least(open, high, low, close) <= 0) AS not_positive, count(*) FILTER (WHERE volume < 0) AS negative_volume FROM bars GROUP BY 1""")
def _(spark, sf):
    """Counts of bars that break price rules."""
    return Q.sanity(bars_1h(spark, sf))


@query("temporal_coverage", f"""
WITH {BARS} SELECT symbol, count(*) AS n, count(*) / 720.0 >= 0.5 AS enough, count(*) / 1500.0 >= 0.5 AS enough_of_1500, false AS none_expected FROM bars GROUP BY 1""")
def _(spark, sf):
    """Share of expected rows that exist, against one half."""
    from candlespark.operators.metrics import coverage

    n = F.col("n")
    return bars_1h(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).select(
        "symbol", "n", coverage(n, F.lit(720)).alias("enough"), coverage(n, F.lit(1500)).alias("enough_of_1500"), coverage(n, F.lit(0)).alias("none_expected"))
