"""Every query outside the numbered operators against its SQL twin on the given tables."""

import pytest

import __spark_entry__ as entry_point
from checks.compare import connect, difference
from checks.oracle import all_sql
from checks.queries import all_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_agrees_with_sql(spark, con, name):
    assert difference(spark, con, name, SF_DIR) is None


def test_every_query_has_a_twin():
    assert set(all_queries()) == set(all_sql())


def test_all_of_them_are_registered():
    assert set(all_queries()) <= set(entry_point.queries())
    assert set(all_sql()) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert {r.db_object_type for r in rows} == {"Table", "View", "Function", "Trigger"}
    counts = [r.object_count for r in rows]
    assert counts == sorted(counts, reverse=True)
