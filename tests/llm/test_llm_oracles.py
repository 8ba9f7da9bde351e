"""The operators' queries that SQL can state, against DuckDB on the same tables."""

import os

import oracle
import pytest

from fleetpulse.llm.queries import entries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
STATED = {name: e for name, e in entries().items() if e.sql}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(STATED))
def test_query(spark, con, name):
    found = STATED[name].run(spark, SF_DIR)
    assert oracle.difference(oracle.spark_rows(found), oracle.duck_rows(con, STATED[name].sql)) is None
