"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from talkgauge.plans.oracle import oracle_queries
from talkgauge.plans.queries import registry
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(registry()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, FOLDER) is None


def test_every_query_has_sql():
    assert set(registry()) == set(oracle_queries())
    assert set(registry()) <= set(entry.queries()) and set(oracle_queries()) <= set(entry.oracle_sql())


def test_flagship_query(spark):
    assert entry.entry(spark).count() > 0
