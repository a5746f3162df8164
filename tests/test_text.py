import hashlib

import pytest
from pyspark.sql import functions as F

from scriptloom.functions import text


def one(spark, value, build):
    frame = spark.createDataFrame([(value,)], "v string")
    return frame.select(build(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("path", "name"),
    [("a/b/c.sql", "c.sql"), ("c.sql", "c.sql"), ("a/", ""), ("s3://x/it's.sql", "it's.sql")],
)
def test_base_name(spark, path, name):
    assert one(spark, path, text.base_name) == name


@pytest.mark.parametrize(
    ("kind", "title"),
    [
        ("table", "Table"),
        ("TABLE", "Table"),
        ("stored procedure", "Stored Procedure"),
        ("user-defined_function", "User-Defined_Function"),
        ("", ""),
        (None, None),
    ],
)
def test_title_case(spark, kind, title):
    assert one(spark, kind, text.title_case) == title


@pytest.mark.parametrize(
    "value", ["", " ", "one", " two words ", "a\nb\tc\r\nd", "x" * 50_000, "w " * 50_000]
)
def test_word_count(spark, value):
    assert one(spark, value, text.word_count) == len(value.split())


NORMALIZED = [
    ("select a -- it's\nfrom b", "SELECT A  \nFROM B"),
    ("select '--x /* y' /* it's */ + 1", "SELECT '--x /* y'   + 1"),
    ("select 'it''s dbo.x'", "SELECT 'it''s dbo.x'"),
    ("[dbo].[My Table]", "DBO.MY_TABLE"),
    ("[a][nvarchar](5)", "A NVARCHAR(5)"),
    ("table[x]as", "TABLE X AS"),
    ('"q"."r"', "Q.R"),
    ("a - b / c", "A - B / C"),
    ("'open", "'open"),
    ("[open", "[OPEN"),
    ("a /* open", "A  "),
    ("", ""),
]


@pytest.mark.parametrize(("sql", "expected"), NORMALIZED)
def test_normalized(spark, sql, expected):
    assert one(spark, sql, lambda c: text.normalized(text.tokens(c))) == expected


@pytest.mark.parametrize(
    "sql",
    ["'" + "x''" * 200_000 + "'", "/*" + "*" * 300_000 + "*/", "[" * 100_000, " " * 300_000],
    ids=["quotes", "stars", "brackets", "blanks"],
)
def test_long_text_is_processed_whole(spark, sql):
    out = one(spark, sql, lambda c: F.md5(F.array_join(text.tokens(c), "")))
    assert out == hashlib.md5(sql.encode()).hexdigest()


@pytest.mark.parametrize(
    ("sql", "irregular"),
    [("[a].[b_1]", False), ("[a b]", True), ("[1a]", True), ("'[a b]'", False), ("--[a b]", False)],
)
def test_irregular_names(spark, sql, irregular):
    assert one(spark, sql, lambda c: text.has_irregular_name(text.tokens(c))) is irregular


def test_map_code_leaves_literals(spark):
    out = one(spark, "a 'a''a' a", lambda c: text.map_code(c, lambda s: F.replace(s, F.lit("a"), F.lit("b"))))
    assert out == "b 'a''a' b"
