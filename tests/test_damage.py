"""Damage inside files: broken pages, footers, foreign types, valid empty files."""

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from candlespark.session import shared_dir
from candlespark.sources import bars as B
from candlespark.sources import damage as D


def bars(symbol, n, first=0):
    i = np.arange(first, first + n)
    return pa.table({
        "symbol": [symbol] * n, "open_time": pa.array(pd.Timestamp("2024-01-01") + pd.to_timedelta(i, "min"), pa.timestamp("us")),
        "close": i * 1.5, "trades_done": i,
    })


def put(folder, name, table, **options):
    os.makedirs(folder, exist_ok=True)
    pq.write_table(table, f"{folder}/{name}", write_page_checksum=True, **options)
    return f"{folder}/{name}"


def spoil(name, group):
    """Flip bytes inside one row group."""
    column = pq.ParquetFile(name).metadata.row_group(group).column(2)
    with open(name, "r+b") as f:
        f.seek(column.data_page_offset + column.total_compressed_size // 2)
        was = f.read(8)
        f.seek(-8, 1)
        f.write(bytes(255 - b for b in was))


@pytest.fixture
def store(spark):
    path = shared_dir(spark, "damage")
    put(f"{path}/symbol_key=a%2Fb", "good.parquet", bars("a", 50))
    spoil(put(path, "page.parquet", bars("b", 100), row_group_size=20), 2)
    put(path, "empty.parquet", bars("c", 0))
    name = put(path, "cut.parquet", bars("d", 30))
    with open(name, "r+b") as f:
        f.truncate(os.path.getsize(name) - 20)
    put(path, "types.parquet", pa.table({"symbol": ["e"], "close": ["no number"]}))
    with open(f"{path}/text.parquet", "w") as f:
        f.write("no parquet at all")
    return path


def test_damage_is_named(spark, store):
    rows = D.damaged_parts(spark, store).collect()
    found = sorted((os.path.basename(r.path), r.row_group, r.n_rows) for r in rows if r.row_group is not None)
    assert found == [("page.parquet", 2, 20), ("types.parquet", 0, 1)]
    assert sorted(os.path.basename(r.path) for r in rows if r.row_group is None) == ["cut.parquet", "text.parquet"]
    assert all(r.error and r.length == os.path.getsize(r.path.replace("file:", "")) for r in rows)


def test_rows_behind_the_damage_are_kept(spark, store):
    rows = D.intact_rows(spark, store).collect()
    assert sum(r.symbol == "a" for r in rows) == 50
    assert sorted(r.n_trades for r in rows if r.symbol == "b") == [*range(40), *range(60, 100)]
    assert {r.symbol for r in rows} == {"a", "b"}
    assert all(r.close == r.n_trades * 1.5 and r.open is None and r.open_time.minute == r.n_trades % 60 for r in rows)


def test_valid_empty_files_are_not_unreadable(spark, store):
    names = {os.path.basename(r.path) for r in B.unreadable_files(spark, store).collect()}
    assert names == {"cut.parquet", "text.parquet"}


def test_a_missing_file_is_no_damage():
    with pytest.raises(FileNotFoundError):
        next(D._groups("/tmp/no-such-folder/x.parquet", D.open_stored))
    assert D.located("/a/b")[1] == D.located("file:/a/b")[1] == D.located("file:///a/b")[1] == "/a/b"


def test_store_without_files(spark):
    path = shared_dir(spark, "none")
    os.makedirs(path)
    assert D.damaged_parts(spark, path).count() == 0 and D.intact_rows(spark, path).count() == 0
