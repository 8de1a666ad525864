"""Every registered query against its SQL, on the small tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

from almanack.catalog import all_oracles, all_queries

QUERIES, SQL = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    diff, _rows = compare(QUERIES[name](spark, sf), con, SQL[name])
    assert diff is None, diff


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
