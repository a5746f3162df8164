import pytest

from scriptloom.operators.translate import (
    TRANSLATORS,
    copy_statements,
    translate_constraint,
    translate_function,
    translate_table,
    translate_trigger,
    translate_view,
    trigger_headers,
)

TABLES = [
    (
        "CREATE TABLE [dbo].[t](\n [Id] [int] NOT NULL, -- key's\n [Name][nvarchar](50) NULL)\nGO\n",
        "CREATE OR REPLACE TABLE T(\n ID INT NOT NULL,  \n NAME TEXT NULL)",
        False,
    ),
    (
        "create table dbo.t(a char(3), b varchar(max) default 'varchar(3) dbo.x', c xml)",
        "CREATE OR REPLACE TABLE T(A TEXT, B TEXT DEFAULT 'varchar(3) dbo.x', C VARIANT)",
        False,
    ),
    (
        "create table sales.t([text] ntext, string int, d national character varying(10), e sysname)",
        "CREATE OR REPLACE TABLE SALES.T(TEXT TEXT, STRING INT, D TEXT, E TEXT)",
        False,
    ),
    (
        "create table t(a xml(content dbo.sc), j json, v varchar(1) default char(65))",
        "CREATE OR REPLACE TABLE T(A VARIANT, J VARIANT, V TEXT DEFAULT CHAR(65))",
        False,
    ),
    ("create table t(a nvarchar ( 20 ), b 'it''s')", "CREATE OR REPLACE TABLE T(A TEXT, B 'it''s')", False),
    ("CREATE TABLE[x](a int)", "CREATE OR REPLACE TABLE X(A INT)", False),
    ("create table [a b](c int identity(1,1))", "CREATE OR REPLACE TABLE A_B(C INT IDENTITY(1,1))", True),
    ("create table mydbo.t(a int)", "CREATE OR REPLACE TABLE MYDBO.T(A INT)", False),
    ("USE [x]\nGO\nSET ANSI_NULLS ON\nGO\ncreate table t(a int)", "CREATE OR REPLACE TABLE T(A INT)", False),
    (
        "create table t(a int)\nGO\ncreate index i on t(a)",
        "CREATE OR REPLACE TABLE T(A INT);\nCREATE INDEX I ON T(A)",
        True,
    ),
]


def test_tables(scripts, values):
    rows = values(
        translate_table(scripts(*[t[0] for t in TABLES])),
        "target_sql",
        "target_object_type",
        "needs_review",
    )
    assert rows == [(sql, "Table", review) for _, sql, review in TABLES]


def test_copy_statement(scripts, values):
    tables = translate_table(scripts("create table dbo.t(a int)", "create table s.[a b](a int)", "x"))
    assert values(copy_statements(tables), "copy_sql") == [
        "COPY INTO T FROM @DATA_STG/T.csv FILE_FORMAT = (TYPE = CSV) ON_ERROR = CONTINUE;",
        "COPY INTO S.A_B FROM @DATA_STG/A_B.csv FILE_FORMAT = (TYPE = CSV) ON_ERROR = CONTINUE;",
        None,
    ]


VIEWS = [
    (
        "create view dbo.v as select a, b as [x], coalesce(c, 1) d, 'a,(b' e from dbo.t",
        "CREATE OR REPLACE VIEW V AS SELECT\n    A,\n    B AS X,\n    COALESCE(C, 1) D,\n    'a,(b' E\nFROM T",
        False,
    ),
    (
        "CREATE OR ALTER VIEW v AS SELECT DISTINCT a,b FROM t",
        "CREATE OR REPLACE VIEW V AS SELECT DISTINCT\n    A,\n    B\nFROM T",
        False,
    ),
    (
        "create view v as select (select max(x) from q) m, b from t",
        "CREATE OR REPLACE VIEW V AS SELECT\n    (SELECT MAX(X) FROM Q) M,\n    B\nFROM T",
        True,
    ),
    (
        "create view v as select a from t union select b from u",
        "CREATE OR REPLACE VIEW V AS SELECT\n    A\nFROM T UNION SELECT B FROM U",
        True,
    ),
    ("create view v as select 1 as a", "CREATE OR REPLACE VIEW V AS SELECT\n    1 AS A", False),
]


def test_views(scripts, values):
    rows = values(translate_view(scripts(*[v[0] for v in VIEWS])), "target_sql", "needs_review")
    assert rows == [(sql, review) for _, sql, review in VIEWS]


def test_long_select_list(scripts, values):
    names = [f"c{i}" for i in range(20_000)]
    sql = values(translate_view(scripts(f"create view v as select {', '.join(names)} from t")), "target_sql")
    assert sql[0].count("\n") == len(names) + 1


FUNCTIONS = [
    (
        "CREATE FUNCTION [dbo].[f] (@p varchar(5))\nRETURNS [varchar](10)\nAS\nBEGIN\n RETURN @p\nEND\nGO",
        "CREATE FUNCTION dbo.f (p varchar(5))\nRETURNS TEXT LANGUAGE SQL\nAS\nBEGIN\n RETURN p\nEND",
        (False, False, False),
    ),
    (
        "create function f(@a int) returns nvarchar(max) as begin declare @x int return 'me@x.com' end",
        "create function f(a int) RETURNS TEXT LANGUAGE SQL as begin declare x int return 'me@x.com' end",
        (True, False, True),
    ),
    (
        "create function f(@a int) returns int as begin if @a = 1 return 'else' return 2 end",
        "create function f(a int) returns int LANGUAGE SQL as begin if a = 1 return 'else' return 2 end",
        (False, True, True),
    ),
    (
        "create function f() returns decimal(10, 2) as begin return 'declare if' end",
        "create function f() returns decimal(10, 2) LANGUAGE SQL as begin return 'declare if' end",
        (False, False, False),
    ),
    (
        "create function f(@a int) returns table as return (select @a a)",
        "create function f(a int) returns table LANGUAGE SQL as return (select a a)",
        (False, False, True),
    ),
    (
        "create function f(@a int) returns @t table (a int) as begin return end",
        "create function f(a int) returns t table (a int) as begin return end",
        (False, False, True),
    ),
]


def test_functions(scripts, values):
    rows = values(
        translate_function(scripts(*[f[0] for f in FUNCTIONS])),
        "target_sql",
        "has_declare",
        "has_branch",
        "needs_review",
    )
    assert rows == [(sql, *flags) for _, sql, flags in FUNCTIONS]


def test_constraints(scripts, values):
    work = scripts(
        "ALTER TABLE [dbo].[a] ADD CONSTRAINT [fk] FOREIGN KEY([x]) REFERENCES [dbo].[b]([y])",
        "ALTER TABLE [dbo].[a] WITH CHECK ADD CONSTRAINT [fk] CHECK (x <> 'dbo.')",
    )
    rows = values(translate_constraint(work), "target_sql", "target_object_type", "needs_review")
    assert rows == [
        ("ALTER TABLE A ADD CONSTRAINT FK FOREIGN KEY(X) REFERENCES B(Y)", None, False),
        ("ALTER TABLE A WITH CHECK ADD CONSTRAINT FK CHECK (X <> 'dbo.')", None, True),
    ]


def test_triggers(scripts, values):
    work = scripts(
        "CREATE TRIGGER [dbo].[t1] ON [dbo].[x] FOR INSERT, UPDATE AS BEGIN print 'dbo.' END\nGO",
        "create trigger s.t on s.x with encryption after delete not for replication as select 1",
        "create trigger t on database for create_table as print 1",
    )
    fields = ("trigger_name", "target_table", "timing", "events", "trigger_body")
    assert values(trigger_headers(work), *fields) == [
        ("T1", "X", "FOR", "INSERT,UPDATE", "BEGIN print 'dbo.' END"),
        ("S.T", "S.X", "AFTER", "DELETE", "select 1"),
        (None,) * 5,
    ]
    plans = values(translate_trigger(work), "target_sql", "target_object_type", "needs_review")
    first = plans[0][0]
    assert first.index("CREATE OR REPLACE PROCEDURE T1_PROC()") < first.index("TASK T1_TASK")
    assert "CALL T1_PROC();" in first
    assert plans[2] == (None, "Task", True)


@pytest.mark.parametrize(
    ("translate", "kind"),
    [
        (translate_table, "Table"),
        (translate_view, "Table"),
        (translate_function, "Table"),
        (translate_trigger, "Table"),
        (translate_constraint, "None"),
    ],
)
def test_compatible_target_kinds(scripts, values, translate, kind):
    assert values(translate(scripts("x"), compat=True), "target_object_type") == [kind]


@pytest.mark.parametrize("kind", list(TRANSLATORS))
def test_a_filter_on_the_text_does_not_translate_again(spark, kind):
    schema = "sql_file_name string, _stg_sql_file_md5 string, sql_body string"
    work = spark.createDataFrame([("a", "b", "CREATE VIEW dbo.v AS SELECT a FROM dbo.t")], schema)
    rows = TRANSLATORS[kind](work).where("target_sql is not null").select("target_sql")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("__" in line for line in filters), filters
