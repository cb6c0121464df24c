"""A bar table of immutable commits: what readers see, what is merged and what is read."""

import datetime as dt

from pyspark.sql import functions as F

from candlespark.session import shared_dir
from candlespark.sources import snapshots as S


def bars(spark, close, months=(1, 2), symbols=("a", "b"), **more):
    rows = [(s, dt.datetime(2024, m, d), float(close)) for s in symbols for m in months for d in (1, 2)]
    return spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, close double").withColumns({k: F.lit(v) for k, v in more.items()})


def closes(df):
    rows = df.collect()
    assert len({(r.source, r.symbol, r.open_time) for r in rows}) == len(rows)
    return {(r.symbol, r.open_time.month): r.close for r in rows}


def test_readers_see_before_or_after(spark):
    """A reader that began before an upsert, a compaction or a broken commit keeps its rows."""
    path = shared_dir(spark, "snapshots")
    S.upsert(bars(spark, 1), path, "x")
    before = S.scan(spark, path)
    S.upsert(bars(spark, 2, [2]), path, "x")
    between = S.scan(spark, path)
    S._write(S._read(spark, path, [S.commits(spark, path)[0].name]).drop("commit"), path, f"{99:020d}-upsert")  # never published
    S.compact(spark, path)
    S.upsert(bars(spark, 3, [3], ["b"]), path, "x")
    assert closes(before) == {("a", 1): 1, ("a", 2): 1, ("b", 1): 1, ("b", 2): 1}
    assert closes(between) == {("a", 1): 1, ("a", 2): 2, ("b", 1): 1, ("b", 2): 2}
    assert closes(S.scan(spark, path)) == {**closes(between), ("b", 3): 3}
    assert closes(S.scan(spark, path, at=1)) == closes(before)


def test_only_months_of_several_commits_are_merged(spark):
    path = shared_dir(spark, "snapshots")
    S.upsert(bars(spark, 1), path, "x")
    S.upsert(bars(spark, 2, [2]), path, "x")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "Exchange" not in plan(S.scan(spark, path, end="2024-01-31 00:00:00"))
    assert "Exchange" in plan(S.scan(spark, path))
    assert S.compact(spark, path) == 3 and S.compact(spark, path) is None
    assert "Exchange" not in plan(S.scan(spark, path))
    # The compaction rewrote February alone, and a scan of one symbol and month reads one file.
    assert S.live_months(S.commits(spark, path)) == {"2024-01": [f"{1:020d}-upsert"], "2024-02": [f"{3:020d}-compact"]}
    one = S.scan(spark, path, ["a"], "2024-02-01", "2024-02-29")
    files = {r.f for r in one.select(F.input_file_name().alias("f")).collect()}
    assert len(files) == 1 and "symbol_key=a/month=2024-02" in files.pop()


def test_repeated_batches_ties_and_sources(spark):
    path = shared_dir(spark, "snapshots")
    assert S.scan(spark, path).count() == 0
    S.upsert(bars(spark, 1), path, "x", "stream", 0)
    S.upsert(bars(spark, 5), path, "x", "stream", 1)
    S.upsert(bars(spark, 1), path, "x", "stream", 0)  # repeated: is part of the table already
    assert set(closes(S.scan(spark, path)).values()) == {5}
    twice = bars(spark, 7, arrival=1).unionByName(bars(spark, 6, arrival=2))
    S.upsert(twice, path, "x")
    S.upsert(bars(spark, 9), path, "y")
    assert set(closes(S.scan(spark, path, source="x")).values()) == {6}
    assert set(closes(S.scan(spark, path, source="y")).values()) == {9}
    S.upsert(bars(spark, 0).limit(0), path, "x")
    untimed = bars(spark, 4, [1], ["c"]).limit(1).withColumn("open_time", F.lit(None).cast("timestamp_ntz"))
    S.upsert(untimed, path, "x")
    assert S.scan(spark, path, ["c"]).first().close == 4 and S.scan(spark, path, ["c"], "2024-01-01").count() == 0


def test_vacuum_keeps_what_newer_snapshots_need(spark):
    path = shared_dir(spark, "snapshots")
    S.upsert(bars(spark, 1, [2]), path, "x")
    S.upsert(bars(spark, 2), path, "x")
    third = S.compact(spark, path)
    S.upsert(bars(spark, 4, [2]), path, "x")
    assert S.vacuum(spark, path, third - 1) == []
    assert S.vacuum(spark, path, third) == [f"{1:020d}-upsert"]
    fifth = S.compact(spark, path)
    want = {("a", 1): 2, ("a", 2): 4, ("b", 1): 2, ("b", 2): 4}
    assert closes(S.scan(spark, path)) == want
    assert S.vacuum(spark, path, fifth) == [f"{third:020d}-compact", f"{4:020d}-upsert"]
    assert closes(S.scan(spark, path)) == want
