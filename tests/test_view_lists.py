"""Select lists of views: where their columns begin, whatever is nested in them."""

import time

import pytest
from pyspark.sql import functions as F

from scriptloom.functions import rules
from scriptloom.operators.once import once
from scriptloom.operators.translate import translate_view


def rewritten(rows):
    head, rest = rules.view_parts(F.col("ddl"))
    rows = once(rows, head=head, rest=rest)
    rows = once(rows, blocks=rules.list_blocks(F.col("rest")))
    rows = once(rows, marked=rules.marked_list(F.col("blocks")))
    rows = once(rows, columns=rules.list_columns(F.col("marked")))
    sql = rules.view_ddl(*[F.col(c) for c in ("ddl", "head", "marked", "columns")])
    return once(rows, sql=sql).select("*", F.col("columns").isNotNull().alias("clear"))


def laid_out(spark, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, ddl string")
    return [(r["sql"], r["clear"]) for r in rewritten(rows).orderBy("k").collect()]


@pytest.mark.parametrize(
    "text,columns",
    [
        ("SELECT A", ["A"]),
        ("SELECT A, B FROM T", ["A", "B"]),
        ("SELECT ALL F(A, G(B, C)), 'x, (y' FROM T", ["F(A, G(B, C))", "'x, (y'"]),
        ("SELECT (A), ((B, C)) FROM T, U", ["(A)", "((B, C))"]),
        ("SELECT TRIM(BOTH FROM A), EXTRACT(YEAR FROM B) FROM T", ["TRIM(BOTH FROM A)", "EXTRACT(YEAR FROM B)"]),
        ("SELECT A IS DISTINCT FROM B, C FROM T", ["A IS DISTINCT FROM B", "C"]),
        ("SELECT DISTINCT_A, FROM_B, T.SELECT_C FROM T", ["DISTINCT_A", "FROM_B", "T.SELECT_C"]),
        ("SELECT COUNT(DISTINCT A), 1 FROM T", ["COUNT(DISTINCT A)", "1"]),
        ("SELECT 'it''s, A', B FROM T", ["'it''s, A'", "B"]),
        ("SELECT *, T.* FROM T", ["*", "T.*"]),
        ("WITH C AS (SELECT F(A, B), D FROM Q) SELECT X FROM C", ["F(A, B)", "D"]),
        ("WITH C AS (SELECT 1, 2) SELECT X FROM C", ["1", "2"]),
    ],
)
def test_columns_stand_on_lines_of_their_own(spark, text, columns):
    sql, clear = laid_out(spark, text)[0]
    assert clear and "\n    " + ",\n    ".join(columns) in sql
    assert "".join(sql.split()) == "".join(text.split())


@pytest.mark.parametrize(
    "text", ["", "NOTHING", "SELECT", "SELECT FROM T", "SELECT A,, B FROM T", "SELECT A, FROM T", "SELECT (A FROM T", "SELECT A, 'open"]
)
def test_unclear_lists_stay(spark, text):
    sql, clear = laid_out(spark, text)[0]
    if text.endswith("'open"):
        # An open literal runs to the end, as a literal does.
        assert clear
    else:
        assert (sql, clear) == (text, False)


def test_nested_lists_are_not_marked_but_sub_selects_are(scripts, values):
    bodies = [
        "CREATE VIEW dbo.v AS SELECT coalesce(upper(a), lower(b)) x, c FROM dbo.t",
        "CREATE VIEW dbo.v AS SELECT a, (SELECT max(b) FROM u) m FROM dbo.t",
        "CREATE VIEW dbo.v AS SELECT a, f(upper(b)) FROM dbo.t",
    ]
    got = values(translate_view(scripts(*bodies)), "target_sql", "needs_review")
    assert got[0] == ("CREATE OR REPLACE VIEW V AS SELECT\n    COALESCE(UPPER(A), LOWER(B)) X,\n    C\nFROM T", False)
    assert got[1] == ("CREATE OR REPLACE VIEW V AS SELECT\n    A,\n    (SELECT MAX(B) FROM U) M\nFROM T", True)
    assert got[2][1] is True


def test_a_megabyte_takes_time_in_proportion(spark):
    def seconds(text):
        rows = spark.createDataFrame([(text,)], "ddl string").cache()
        rows.count()
        out = rewritten(rows).select("sql", "clear")
        start = time.perf_counter()
        row = out.first()
        return time.perf_counter() - start, row

    shapes = [
        lambda n: "SELECT " + ", ".join(["A"] * n) + " FROM T",
        lambda n: "SELECT " + "(" * n + "A" + ")" * n + ", B FROM T",
        lambda n: "SELECT " + ", ".join(["COALESCE(F(A, 'x, y'), (B))"] * (n // 6)) + " FROM T",
    ]
    for shape in shapes:
        seconds(shape(1_000))
        small, _ = seconds(shape(60_000))
        large, row = seconds(shape(300_000))
        assert row["clear"] and len(row["sql"]) > 600_000
        assert large < 10 * max(small, 0.5)
