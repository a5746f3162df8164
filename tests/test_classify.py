import json

from pyspark.sql import functions as F

from scriptloom.operators.classify import (
    classification_rejects,
    classify_scripts,
    parse_classification,
    usable,
)
from scriptloom.schema import CLASS_KEYS

HEADERS = [
    ("create   table dbo.A(x int)", ("DDL", "table", "create", "dbo", "A")),
    (
        "/* c */ -- d\nCREATE OR ALTER VIEW [my schema].[v.1] as select 1",
        ("DDL", "view", "create", "my schema", "v.1"),
    ),
    (
        "USE [db]\r\nGO\r\nSET ANSI_NULLS ON\r\nGO\r\nALTER TRIGGER sales.tr ON x",
        ("DDL", "trigger", "alter", "sales", "tr"),
    ),
    (
        "IF OBJECT_ID('dbo.x') IS NOT NULL DROP TABLE dbo.x;\nGO\nCREATE TABLE dbo.x (a int)",
        ("DDL", "table", "create", "dbo", "x"),
    ),
    ("IF EXISTS (select 1)\n DROP VIEW v\nGO\nCREATE VIEW v AS", ("DDL", "view", "create", None, "v")),
    ("CREATE /* x */ FUNCTION -- y\n f() RETURNS int", ("DDL", "function", "create", None, "f")),
    ("ALTER TABLE s.t ADD CONSTRAINT c", ("DDL", "table", "alter", "s", "t")),
    ("CREATE TABLE db..t(a int)", ("DDL", "table", "create", None, "t")),
    ("CREATE TABLE srv.db.sc.t(a int)", ("DDL", "table", "create", "sc", "t")),
    ("CREATE PROC dbo.p AS SELECT 1", ("DDL", "procedure", "create", "dbo", "p")),
    ("DROP TABLE IF EXISTS a.b", ("DDL", "table", None, "a", "b")),
    ("insert into [dbo].[t] values(1)", ("DML", None, None, "dbo", "t")),
    ("DELETE FROM dbo.x", ("DML", None, None, "dbo", "x")),
    ("update s.t set a=1", ("DML", None, None, "s", "t")),
    ("with c as (select 1) select * from c", ("DML", None, None, None, None)),
    ("GRANT SELECT, INSERT ON OBJECT::dbo.t TO u", ("DCL", None, None, "dbo", "t")),
    ("DENY VIEW STATE TO y", ("DCL", None, None, None, None)),
    ("createtable x", (None,) * 5),
    ("", (None,) * 5),
    (" " * 200_000 + "CREATE TABLE t(a int)", ("DDL", "table", "create", None, "t")),
    ("--x\n" * 50_000 + "CREATE VIEW z AS SELECT 1", ("DDL", "view", "create", None, "z")),
]


def test_headers(scripts, values):
    replies = values(classify_scripts(scripts(*[h for h, _ in HEADERS])), "response")
    for (header, expected), reply in zip(HEADERS, replies):
        found = json.loads(reply)
        assert list(found) == CLASS_KEYS
        assert tuple(found.values()) == expected, header[:80]


GOOD = json.dumps(dict.fromkeys(CLASS_KEYS, "x"))
CASES = [
    GOOD,
    f"  {GOOD}\n",
    GOOD.replace('"x"', "null", 1),
    GOOD.replace('"x"', "NaN", 1),
    GOOD.replace('"x"', '{"a": [1, 2]}', 1),
    GOOD.replace('"x"', "7", 1),
    GOOD.replace("{", '{"more": [1, {"b": null}], ', 1),
    GOOD.replace("{", '{"stmt_type": "first", ', 1),
    GOOD.replace('"x"', r'"q\"é\n"', 1),
    GOOD.replace('"x"', "-Infinity", 1),
    GOOD.replace('"x"', "+Infinity", 1),
    GOOD.replace('"x"', r'"\"+I"', 1),
    GOOD + " tail",
    GOOD + "] tail",
    GOOD + "} tail",
    f"{GOOD},{GOOD}",
    f"[{GOOD}]",
    GOOD.replace('"', "'"),
    "",
    None,
    GOOD[:-1],
    f"```json\n{GOOD}\n```",
    GOOD.replace('"x"', '"a\nb"', 1),
    GOOD.replace('"x"', "01", 1),
    GOOD.replace("{", "{/*c*/", 1),
    GOOD[:-1] + ",}",
    "null",
    "3",
    '"stmt_type"',
    *[json.dumps({k: "x" for k in CLASS_KEYS if k != gone}) for gone in CLASS_KEYS],
]


def strict(reply):
    try:
        fields = json.loads(reply)
        return {k: fields[k] for k in CLASS_KEYS}
    except (TypeError, ValueError, KeyError):
        return None


def test_replies_are_parsed_strictly(spark):
    frame = spark.createDataFrame(
        [(f"{i:03d}", f"p{i}", "m", r) for i, r in enumerate(CASES)],
        "sql_file_name string, path string, md5 string, response string",
    )
    parsed = parse_classification(frame)
    rows = sorted(parsed.collect(), key=lambda r: r.sql_file_name)
    for reply, row in zip(CASES, rows):
        expected = strict(reply)
        assert (row.fault is None) == (expected is not None), reply
        if expected is None:
            assert all(row[k] is None for k in CLASS_KEYS)
            continue
        for key, value in expected.items():
            if value is None or isinstance(value, str):
                assert row[key] == value, reply
            else:
                assert row[key] is not None
    good = sum(strict(r) is not None for r in CASES)
    assert usable(parsed).count() == good
    assert classification_rejects(parsed).count() == len(CASES) - good


def test_reject_reasons(spark):
    replies = [None, "nope", json.dumps({"stmt_type": "DDL", "object_type": "x"})]
    frame = spark.createDataFrame(
        [(str(i), "p", "m", r) for i, r in enumerate(replies)],
        "sql_file_name string, path string, md5 string, response string",
    )
    rows = sorted(
        classification_rejects(parse_classification(frame)).collect(),
        key=lambda r: r.sql_file_name,
    )
    assert [r.reason for r in rows] == [
        "no reply",
        "not a JSON object",
        "missing key: operation_type",
    ]
    failed = frame.limit(1).withColumn("error", F.lit("timeout"))
    assert parse_classification(failed).first().fault == "service: timeout"
