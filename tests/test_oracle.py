"""Every query against its SQL on the given tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry_point
from vitaframe.plans.catalog import QUERIES as CATALOGUE

SF_DIR = "/root/testdata/sf0.01"
QUERIES = entry_point.queries()
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_of_the_catalogue_has_sql():
    assert set(CATALOGUE) <= set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert {r["metric_type"] for r in rows} == {"bp", "sleep", "steps", "hr", "temp"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None
