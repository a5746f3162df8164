"""Scripts as tools export them, with what is expected of each written out by hand.

`~id~` stands for the script's number. A template is its kind, its text, and the expected
translation, review mark, sources of a view, (joins, sub-selects, groupings), and for
functions and triggers the values of their extra columns.
"""

from __future__ import annotations

MARK = "~id~"

TEMPLATES = [
    dict(
        kind="table",
        body="SET ANSI_NULLS ON\nGO\nCREATE TABLE [sales].[Order~id~](\n  [Id] [int] NOT NULL,\n"
        "  [Group] [nvarchar](50) NULL,\n  [Total] AS ([Id] + 1)\n) ON [PRIMARY]\nGO\n",
        target="CREATE OR REPLACE TABLE SALES.ORDER~id~(\n  ID INT NOT NULL,\n  GROUP TEXT NULL,\n"
        "  TOTAL AS (ID + 1)\n) ON PRIMARY",
        review=True,
    ),
    dict(
        kind="table",
        body="CREATE TABLE dbo.plain~id~ (\n  a int PRIMARY KEY,\n  b char(3) DEFAULT          CHAR(65),\n"
        "  c varchar(10) DEFAULT 'x'\n)",
        target="CREATE OR REPLACE TABLE PLAIN~id~ (\n  A INT PRIMARY KEY,\n  B TEXT DEFAULT          CHAR(65),\n"
        "  C TEXT DEFAULT 'x'\n)",
        review=False,
    ),
    dict(
        kind="table",
        body="USE [shop]\nGO\nCREATE TABLE [Adv].[dbo].[T~id~](a int)\nGO\n",
        target="CREATE OR REPLACE TABLE ADV.DBO.T~id~(A INT)",
        review=True,
    ),
    dict(
        kind="view",
        name=("SALES", "V"),
        body="CREATE VIEW sales.v AS WITH c AS (SELECT a FROM dbo.q) SELECT a, b FROM c, dbo.t~id~ x",
        target="CREATE OR REPLACE VIEW SALES.V AS WITH C AS (SELECT\n    A\nFROM Q) SELECT A, B FROM C, T~id~ X",
        review=True,
        sources=["Q", "T~id~"],
        points=(0, 1, 0),
    ),
    dict(
        kind="view",
        name=("HR", "V"),
        body="CREATE VIEW hr.v AS SELECT a, b FROM dbo.a~id~ WITH (NOLOCK), dbo.b JOIN dbo.c ON 1 = 1, dbo.d",
        target="CREATE OR REPLACE VIEW HR.V AS SELECT\n    A,\n    B\nFROM A~id~ WITH (NOLOCK), B JOIN C ON 1 = 1, D",
        review=True,
        sources=["A~id~", "B", "C", "D"],
        points=(1, 0, 0),
    ),
    dict(
        kind="view",
        name=("DBO", "BIG"),
        body="CREATE VIEW dbo.big AS SELECT a, count(b) n FROM t0"
        + "".join(f" JOIN t{k} ON 1 = 1" for k in range(1, 7))
        + " WHERE a IN (SELECT x FROM s~id~) GROUP BY a",
        target="CREATE OR REPLACE VIEW BIG AS SELECT\n    A,\n    COUNT(B) N\nFROM T0"
        + "".join(f" JOIN T{k} ON 1 = 1" for k in range(1, 7))
        + " WHERE A IN (SELECT X FROM S~id~) GROUP BY A",
        review=True,
        sources=[*(f"T{k}" for k in range(7)), "S~id~"],
        points=(6, 1, 1),
    ),
    dict(
        kind="view",
        name=("DBO", "W~id~"),
        body="CREATE VIEW dbo.w~id~ AS SELECT upper(a) u, b FROM sales.t~id~",
        target="CREATE OR REPLACE VIEW W~id~ AS SELECT\n    UPPER(A) U,\n    B\nFROM SALES.T~id~",
        review=False,
        sources=["SALES.T~id~"],
    ),
    dict(
        kind="function",
        body="CREATE OR ALTER FUNCTION dbo.f~id~(@a int) RETURNS int AS BEGIN IF @a = 1 RETURN 2 ELSE RETURN 3 RETURN 4 END",
        target="CREATE OR REPLACE FUNCTION dbo.f~id~(a int) RETURNS int LANGUAGE SQL AS BEGIN IF a = 1 RETURN 2 "
        "ELSE RETURN 3 RETURN 4 END",
        review=True,
        extra={"has_declare": False, "has_branch": True},
    ),
    dict(
        kind="function",
        body="CREATE FUNCTION dbo.g~id~(@a int) RETURNS TABLE AS RETURN SELECT @a x",
        target="CREATE FUNCTION dbo.g~id~(a int) RETURNS TABLE LANGUAGE SQL AS RETURN SELECT a x",
        review=True,
        extra={"has_declare": False, "has_branch": False},
    ),
    dict(
        kind="function",
        body="CREATE FUNCTION dbo.h~id~() RETURNS dbo.Flag AS BEGIN RETURN 1 END",
        target="CREATE FUNCTION dbo.h~id~() RETURNS dbo.Flag LANGUAGE SQL AS BEGIN RETURN 1 END",
        review=True,
        extra={"has_declare": False, "has_branch": False},
    ),
    dict(
        kind="function",
        body="CREATE FUNCTION dbo.k~id~(@a int) RETURNS int AS BEGIN RETURN @a + 1 END",
        target="CREATE FUNCTION dbo.k~id~(a int) RETURNS int LANGUAGE SQL AS BEGIN RETURN a + 1 END",
        review=False,
        extra={"has_declare": False, "has_branch": False},
    ),
    dict(
        kind="trigger",
        body="CREATE TRIGGER dbo.g~id~ ON dbo.t WITH ENCRYPTION, EXECUTE AS CALLER INSTEAD OF INSERT, UPDATE AS SELECT 1",
        target="CREATE OR REPLACE PROCEDURE G~id~_PROC()\nRETURNS TEXT\nLANGUAGE SQL\nAS\n$$\nBEGIN\n    SELECT 1\nEND\n$$;"
        "\n\n-- Replaces the trigger on T for INSERT,UPDATE\nCREATE OR REPLACE TASK G~id~_TASK\n"
        "    SCHEDULE = '1 MINUTE'\nAS\n    CALL G~id~_PROC();",
        review=True,
        extra={"trigger_name": "G~id~", "target_table": "T", "timing": "INSTEAD OF", "events": "INSERT,UPDATE"},
        trigger_body="SELECT 1",
    ),
    dict(
        kind="trigger",
        body="CREATE TRIGGER dbo.u~id~ ON dbo.t AFTER NOTHING AS SELECT 1",
        target=None,
        review=True,
        extra={"trigger_name": None, "target_table": None, "timing": None, "events": None},
        trigger_body=None,
    ),
    dict(
        kind="constraint",
        body="ALTER TABLE [dbo].[order] WITH CHECK ADD CONSTRAINT c~id~ CHECK (a > 1)",
        target="ALTER TABLE ORDER WITH CHECK ADD CONSTRAINT C~id~ CHECK (A > 1)",
        review=True,
    ),
]

TARGET_TYPES = {"table": "Table", "view": "View", "function": "Function", "trigger": "Task", "constraint": None}


def _literal(value) -> str:
    if value is None:
        return "cast(null as string)"
    if isinstance(value, (bool, int)):
        return str(value).lower()
    quoted = value.replace("'", "''")
    return f"replace('{quoted}', '{MARK}', cast(id as string))"


def by_template(value_of, templates=None) -> str:
    """SQL that gives each script the value of its template."""
    whens = [f"when {k} then {_literal(value_of(t))}" for k, t in enumerate(TEMPLATES) if templates is None or t in templates]
    return f"case id % {len(TEMPLATES)} " + " ".join(whens) + " end"


def body_sql() -> str:
    """The text of script `id`; Spark and DuckDB run it alike."""
    return by_template(lambda t: t["body"])


_SCRIPTS = """
with scripts as (
  select distinct string_split(path, '/')[-1] as sql_file_name, md5 as _stg_sql_file_md5, id
  from ({corpus}) where regexp_full_match(path, '.*MS-SQL-Server-Script.*[.]sql')
)
"""


def exported_sql(corpus: str) -> dict[str, str]:
    """Expected rows of the `_exported` queries."""
    head = _SCRIPTS.format(corpus=corpus)
    key = "sql_file_name, _stg_sql_file_md5"
    numbers = {kind: [k for k, t in enumerate(TEMPLATES) if t["kind"] == kind] for kind in TARGET_TYPES}

    def of(kind: str) -> str:
        return f"id % {len(TEMPLATES)} in ({', '.join(map(str, numbers[kind]))})"

    found = {}
    for kind, target_type in TARGET_TYPES.items():
        own = [t for t in TEMPLATES if t["kind"] == kind]
        extra = "".join(
            f", {by_template(lambda t, n=name: t['extra'][n], own)} as {name}" for name in own[0].get("extra", {})
        )
        found[f"translate_{kind}_exported"] = (
            f"{head} select {key}, {by_template(lambda t: t['target'], own)} as target_sql, "
            f"{_literal(target_type)} as target_object_type, {by_template(lambda t: t['review'], own)} as needs_review"
            f"{extra} from scripts where {of(kind)}"
        )
    triggers = [t for t in TEMPLATES if t["kind"] == "trigger"]
    fields = ", ".join(
        f"{by_template(lambda t, n=name: t['extra'][n], triggers)} as {name}" for name in triggers[0]["extra"]
    )
    body = by_template(lambda t: t["trigger_body"], triggers)
    found["trigger_headers_exported"] = f"{head} select {key}, {fields}, {body} as trigger_body from scripts where {of('trigger')}"
    views = [t for t in TEMPLATES if t["kind"] == "view"]
    named = (
        f"{key}, {by_template(lambda t: t['name'][0], views)} as schema_name, "
        f"{by_template(lambda t: t['name'][1], views)} as object_name"
    )
    lists = by_template(lambda t: "|".join(t["sources"]), views)
    found["view_dependencies_exported"] = (
        f"{head} select {named}, unnest(string_split({lists}, '|')) as depends_on from scripts where {of('view')}"
    )
    found["view_dependency_counts_exported"] = (
        f"{head} select {named}, len(string_split({lists}, '|')) as n_dependencies from scripts where {of('view')}"
    )
    points = [
        f"{by_template(lambda t, k=k: t.get('points', (0, 0, 0))[k])} as {name}"
        for k, name in enumerate(("n_joins", "n_subselects", "n_groupings"))
    ]
    label = by_template(lambda t: ["Simple", "Medium", "Medium"][s] if (s := sum(t.get("points", (0,)))) < 3 else "Complex" if s < 6 else "Very Complex")
    found["script_complexity_exported"] = f"{head} select {key}, {', '.join(points)}, {label} as complexity from scripts"
    return found
