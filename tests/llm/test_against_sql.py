"""The numbered operators against their SQL on the given tables."""

import pytest

from checks.compare import _sorted, connect
from scriptloom.llm.queries import llm_queries, llm_sql

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_query_agrees_with_sql(spark, name):
    frame = llm_queries()[name](spark, SF_DIR)
    mine = _sorted(frame.collect(), frame.columns)
    cursor = connect(SF_DIR).execute(llm_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert mine == _sorted(cursor.fetchall(), names) and mine


def test_every_sql_has_its_query():
    assert set(llm_sql()) <= set(llm_queries())
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in llm_queries()}
