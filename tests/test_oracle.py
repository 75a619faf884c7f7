"""Every named query with checking SQL agrees with it, row by row."""

import os

import pytest
from compare import SMALL, connect, difference

import __spark_entry__ as contract
from tiermill.plans import registry

FOLDER = os.environ.get("ORACLE_SF_DIR", SMALL)
CHECKS = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, FOLDER), duck, CHECKS[name]) == ""


def test_every_query_has_a_check():
    assert set(registry.PLANS) == set(registry.CHECKS) and set(registry.PLANS) <= set(QUERIES)


def test_entry_gives_rows(spark):
    frame = contract.entry(spark)
    assert frame.limit(1).count() == 1
    assert "total_revenue_usd" in frame.columns
