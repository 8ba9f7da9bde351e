"""Every registered query against DuckDB on the same tables."""

import os

import oracle
import pytest

import __spark_entry__ as registry

from fleetpulse.plans.registry import entries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()
FLEET = entries()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(FLEET) <= set(QUERIES) and set(FLEET) <= set(SQL)


def test_entry(spark):
    assert registry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(FLEET))
def test_query(spark, con, name):
    found = oracle.spark_rows(QUERIES[name](spark, SF_DIR))
    assert oracle.difference(found, oracle.duck_rows(con, SQL[name])) is None
    assert found[1], "a query without rows checks nothing"
