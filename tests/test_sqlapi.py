import pytest

from scriptloom.operators.sqlapi import SqlMemo


def test_query_and_memo(spark):
    memo = SqlMemo(spark)
    frame = memo.query("select id from range(3)")
    assert frame.count() == 3
    assert memo.query("select id from range(3)") is frame


@pytest.mark.parametrize(
    "text", [None, 7, "selec 1", "select * from missing_table", "select 1 / (id - id) from range(2)"]
)
def test_any_failure_gives_an_empty_frame(spark, text):
    frame = SqlMemo(spark).query(text)
    assert frame.columns == []
    assert frame.count() == 0


def test_single_column(spark):
    memo = SqlMemo(spark)
    names = memo.single_column("select 'x' as name, 1 as other union all select null, 2")
    assert sorted(str(r.name) for r in names.collect()) == ["None", "x"]
    missing = memo.single_column("select id as NAME from range(2)")
    assert [r.name for r in missing.collect()] == [None, None]
    assert memo.single_column("selec").count() == 0


def test_memo_is_bounded(spark):
    memo = SqlMemo(spark, size=2)
    first = memo.query("select 1")
    memo.query("select 2")
    memo.query("select 3")
    assert not first.is_cached
    assert memo.query("select 1") is not first


def test_the_same_query_with_other_blanks(spark):
    memo = SqlMemo(spark)
    first = memo.query("select id + 1 as n from range(3)")
    assert memo.query("SELECT  id + 1\n  AS n -- the next\nFROM range(3)") is first
    assert memo.query("select id + 2 as n from range(3)") is not first
    assert memo.query("select id + 1 as m from range(3)").columns == ["m"]


def test_an_overwritten_table_misses(spark, tmp_path):
    path = str(tmp_path / "table")
    text = f"select count(*) as n from parquet.`{path}`"
    spark.range(3).write.parquet(path)
    memo = SqlMemo(spark)
    first = memo.query(text)
    assert first.first().n == 3 and memo.query(text.replace("select", "SELECT  ")) is first
    spark.range(5).write.mode("overwrite").parquet(path)
    second = memo.query(text)
    assert second.first().n == 5 and not first.is_cached
    spark.range(2).write.mode("append").parquet(path)
    assert memo.query(text).first().n == 7
    assert len(memo._memo) == 1


def test_a_command_runs_once(spark):
    memo = SqlMemo(spark)
    text = "create temporary view memo_once as select 1 as a"
    assert memo.query(text) is memo.query(text)
    spark.sql("drop view memo_once")
