"""Staging folders and what the store reads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from candlespark import session
from candlespark.sources import bars as S


class Elsewhere:
    """A session of a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(_, default=None):
            return default

    class sparkContext:
        master = "spark://head:7077"


@pytest.mark.parametrize("master", ["spark://head:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://x"])
def test_no_machine_local_folder_on_a_cluster(monkeypatch, master):
    monkeypatch.setattr(Elsewhere.sparkContext, "master", master)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere, "x")


def _bars(spark, days):
    rows = [(s, dt.datetime(2024, 1, d), float(d)) for s in ("a/b", "c") for d in days]
    return spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, close double")


def test_upsert_reads_touched_folders_only(spark):
    store = session.shared_dir(spark, "store")
    S.upsert_bars(_bars(spark, range(1, 20)), store, "x")
    marked = S.with_layout(_bars(spark, [3, 5]).where("symbol = 'c'"), "x")
    where = S.touched(marked)
    plan = spark.read.schema(S.STORED).parquet(store).where((F.col("source") == "x") & where)._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "dt" in filters and "symbol_key" in filters and "source" in filters
    assert len(spark.read.schema(S.STORED).parquet(store).where(where).inputFiles()) >= 2
    assert spark.read.schema(S.STORED).parquet(store).where(where).count() == 2
    assert S.touched(marked.limit(0)) is None


def test_staged_copies_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "shared_dir", lambda _, name: f"{tmp_path}/{name}")
    S.upsert_bars(_bars(spark, [1, 2]), f"{tmp_path}/store", "x")
    S.upsert_bars(_bars(spark, [2, 3]), f"{tmp_path}/store", "x")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["store"]


def test_live_look_back_prunes_days(spark):
    from candlespark.operators.features import look_back_hours

    store = session.shared_dir(spark, "store")
    S.upsert_bars(_bars(spark, range(1, 20)), store, "x")
    now = dt.datetime(2024, 1, 19, 0, 1)
    recent = S.scan_bars(spark, store, start=now - dt.timedelta(hours=look_back_hours("1d", 5)), source="x")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "dt" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")] and plan.count("FileScan") == 1
    assert recent.count() == 12  # six midnights of two symbols within five days and two hours
