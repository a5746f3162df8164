"""Scripts that rules must not translate silently: each is flagged, or kept as it means."""

import pytest

from scriptloom.operators.translate import (
    translate_constraint,
    translate_function,
    translate_table,
    translate_trigger,
    translate_view,
    trigger_headers,
)

FLAGGED = {
    "table": [
        "create table [Order]([Group] int, [User] varchar(3))",
        "create table [Adv].[dbo].[T](a int)",
        "create table t(a [dbo].[Name])",
        "create table t(a int, b as (a + 1))",
        "create table t(a int) on ps(a)",
        "create table t(a datetime default sysdatetime())",
        "create table t(a int default newsequentialid())",
        "create table t(a varchar(3) default N'x')",
        "create table t(a varchar(9) default convert(varchar(10), 1))",
    ],
    "view": [
        "create view v as select a from [order]",
        "create view v as select a from [Adv].[dbo].[T]",
        "create view v as select iif(a, 1, 2) x from t",
        "create view v as select len(a) x from t",
        "create view v as select datediff(day, a, b) x from t",
        "create view v as select a from t where b = N'x'",
    ],
    "function": [
        "create function f() returns dbo.Flag as begin return 1 end",
        "alter function f() returns int as begin return 1 end",
        "create function f(@a dbo.Name) returns int as begin return 1 end",
        "create function f(@a int) returns int as begin return len(@a) end",
    ],
    "constraint": ["alter table [order] add constraint c check (a > 1)"],
}
TRANSLATE = {"table": translate_table, "view": translate_view, "function": translate_function, "constraint": translate_constraint}


@pytest.mark.parametrize("kind", sorted(FLAGGED))
def test_flagged(scripts, values, kind):
    found = values(TRANSLATE[kind](scripts(*FLAGGED[kind])), "needs_review", "target_sql")
    assert [sql for sql, (review, _) in zip(FLAGGED[kind], found) if not review] == []


def test_plain_scripts_are_not(scripts, values):
    tables = ["create table dbo.t(a int primary key, b varchar(3) default 'x', c decimal(3, 1) check (c > 0), foreign key (a) references dbo.u(a))"]
    assert values(translate_table(scripts(*tables)), "needs_review") == [False]
    views = ["create view dbo.v as select count(a) n, upper(b) u from dbo.t x join s.u on x.a = s.u.b where a in (1, 2) group by b"]
    assert values(translate_view(scripts(views[0].replace("s.u.b", "y.b"))), "needs_review") == [False]


@pytest.mark.parametrize("blanks", [1, 8, 9, 40])
def test_a_default_value_is_no_type(scripts, values, blanks):
    sql = f"create table t(a varchar(3) default{' ' * blanks}char(65))"
    assert values(translate_table(scripts(sql)), "target_sql") == [f"CREATE OR REPLACE TABLE T(A TEXT DEFAULT{' ' * blanks}CHAR(65))"]


def test_names_of_three_parts_keep_their_schema(scripts, values):
    sql = values(translate_table(scripts("create table [Adv].[dbo].[T](a int)")), "target_sql")
    assert sql == ["CREATE OR REPLACE TABLE ADV.DBO.T(A INT)"]


def test_create_or_alter_function(scripts, values):
    sql = values(translate_function(scripts("CREATE OR ALTER FUNCTION f() RETURNS dbo.Flag AS BEGIN RETURN 1 END")), "target_sql")
    assert sql == ["CREATE OR REPLACE FUNCTION f() RETURNS dbo.Flag LANGUAGE SQL AS BEGIN RETURN 1 END"]


@pytest.mark.parametrize(
    "options",
    ["", "with append ", "with encryption, execute as caller, a, b, c, d, e, f, g, h, i ", "with execute as 'x' "],
)
def test_triggers_with_any_options(scripts, values, options):
    before = f"create trigger g on t {options if 'append' not in options else ''}after insert, update "
    sql = before + (options if "append" in options else "") + "as select 1"
    found = values(trigger_headers(scripts(sql)), "trigger_name", "timing", "events", "trigger_body")
    assert found == [("G", "AFTER", "INSERT,UPDATE", "select 1")]


def test_an_unread_trigger_has_no_translation(scripts, values):
    found = values(translate_trigger(scripts("create trigger g on t after bogus as select 1")), "target_sql", "needs_review")
    assert found == [(None, True)]
