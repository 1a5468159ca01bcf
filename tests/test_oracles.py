"""Every registered query with SQL equals that SQL, exactly, on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    rows = QUERIES[name](spark, FOLDER)
    assert difference(rows, duck, ORACLES[name]) is None
    assert not rows.isEmpty()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() == 4


def test_no_stale_sql():
    assert set(ORACLES) <= set(QUERIES)
