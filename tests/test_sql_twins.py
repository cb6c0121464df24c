"""Every registered query against its SQL twin, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import check, connect

SMALL = "/root/testdata/sf0.001"
SQL = sorted(entry.oracle_sql())
ROWS = sorted(set(entry.queries()) - set(SQL))


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", SQL)
def test_same_rows(spark, duck, name):
    text = check(spark, duck, name, SMALL)
    assert text.startswith(("ok", "EMPTY")), text
    assert "TYPES" not in text, text


@pytest.mark.parametrize("name", ROWS)
def test_gives_rows(spark, name):
    # The smallest tables are too sparse for a full live window.
    sf_dir = SMALL.replace("0.001", "0.01") if "live" in name else SMALL
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
