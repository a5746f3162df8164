import pytest
from pyspark.sql import functions as F

from scriptloom.operators.lineage import (
    parse_dependency_reply,
    parse_summary_reply,
    script_complexity,
    view_dependencies,
    view_dependency_counts,
)

VIEWS = [
    ("create view v as select a from dbo.t", {"T"}),
    ("create view v as select a from [dbo].[t] x join db.dbo.u y on 1=1 left join s.[a b] on 1=1", {"T", "DB.DBO.U", "S.A_B"}),
    ("create view v as with c as (select 1 a from q), d (x) as (select 2) select * from c, d, e z, dbo.f", {"Q", "E", "F"}),
    ("create view v as select 'from lit' /* from c1 */ from t -- join c2\n", {"T"}),
    ("create view v as select * from (select * from inner_t) i where x in (select y from z)", {"INNER_T", "Z"}),
    ("create view v as select a from t union all select a from T", {"T"}),
    ("create view v as select 1 as a", set()),
    ("create view v as select a from t order by b, c", {"T"}),
    ("create view v as select a from #tmp, t as x, u", {"#TMP", "T", "U"}),
    ("create view v as select 1 a from a with (nolock), b (nolock) join c on 1=1", {"A", "B", "C"}),
    ("create view v as select 1 a from a x join b y on x.i = y.i, c z", {"A", "B", "C"}),
    ("create view v as select 1 a from (a join b on a.i = b.i)", {"A", "B"}),
    ("create view v as select trim('x' from col) c from t where a is not distinct from b", {"T"}),
    ("create view v as select case when a = 1 then 2 end x, y from t join u on f(a, b) = c where d in (1, 2)", {"T", "U"}),
]


def test_dependencies(scripts):
    views = scripts(*[v[0] for v in VIEWS]).withColumns(
        {"object_name": F.col("sql_file_name"), "schema_name": F.lit("s")}
    )
    found = {}
    for row in view_dependencies(views).collect():
        found.setdefault(row.sql_file_name, set()).add(row.depends_on)
    for i, (sql, expected) in enumerate(VIEWS):
        assert found.get(f"f{i:03d}.sql", set()) == expected, sql
    counts = {r.object_name: r.n_dependencies for r in view_dependency_counts(views).collect()}
    assert counts == {f"F{i:03d}.SQL": len(e) for i, (_, e) in enumerate(VIEWS)}


NESTED = [
    ("create view v as select 1 a from a join b on isnull(a.x, cast(b.y as int)) = 1, c", {"A", "B", "C"}),
    ("create view v as select 1 a from a join b on f(g(h(i(1)), 2)) = (1), c with (nolock, index (i)), d", {"A", "B", "C", "D"}),
    ("create view v as select f(g(1), 2), z from (select 1 x from a join b on f(g(h(1))) = 1, c) q join d on f(g(1)) = 1, e", {"A", "B", "C", "D", "E"}),
    ("create view v as select 1 a from a join b on f((select max(y) from t)) = 1, c", {"A", "B", "C", "T"}),
    ("create view v as select 1 a from a join b on f(g(1)) = 1 order by h(i(1)), z", {"A", "B"}),
    ("create view v as select 1 a from a join b on f(" + "(" * 20_000 + ", c", {"A", "B"}),
    ("create view v as select 1 a from a join b on " + "(" * 60 + "1" + ")" * 60 + " = 1, c", {"A", "B", "C"}),
]


def test_lists_go_on_after_nested_conditions(scripts):
    views = scripts(*[v[0] for v in NESTED]).withColumns(
        {"object_name": F.col("sql_file_name"), "schema_name": F.lit("s")}
    )
    found = {}
    for row in view_dependencies(views).collect():
        found.setdefault(row.sql_file_name, set()).add(row.depends_on)
    for i, (sql, expected) in enumerate(NESTED):
        assert found.get(f"f{i:03d}.sql", set()) == expected, sql[:200]


def test_views_of_one_name_stay_apart(spark):
    views = spark.createDataFrame(
        [("a", "1", "sales", "v", "create view sales.v as select x from t"),
         ("b", "2", "hr", "v", "create view hr.v as select x from t, u"),
         ("b", "3", "hr", "v", "create view hr.v as select x from w"),
         ("c", "4", None, None, "select 1")],
        "sql_file_name string, _stg_sql_file_md5 string, schema_name string, object_name string, sql_body string",
    )
    counts = view_dependency_counts(views)
    assert sorted((r[0], r[1], r[4]) for r in counts.collect()) == [("a", "1", 1), ("b", "2", 2), ("b", "3", 1), ("c", "4", 0)]
    assert view_dependencies(views).count() == 4
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("sql", "label"),
    [
        ("select 'join' from a -- group by", "Simple"),
        ("select * from a join b on 1=1", "Medium"),
        ("select * from a join b join c where x in (select 1)", "Complex"),
        ("select * from a" + " join b on 1=1" * 5 + " group by x", "Very Complex"),
    ],
)
def test_complexity(scripts, values, sql, label):
    assert values(script_complexity(scripts(sql)), "complexity") == [label]


def replies(scripts, *texts):
    return scripts(*texts).withColumnRenamed("sql_body", "response")


def test_dependency_reply(scripts):
    parsed = parse_dependency_reply(
        replies(scripts, "This depends on\n1. Table-x\n 2.  View-y \r\n3. and\n4", "none", None)
    )
    found = sorted((r.sql_file_name, r.position, r.depends_on) for r in parsed.collect())
    assert found == [
        ("f000.sql", 1, "Table-x"),
        ("f000.sql", 2, "View-y"),
        ("f000.sql", 3, "and"),
    ]


def test_summary_reply(scripts, values):
    texts = [
        "Summary: Reads rows.\nExpected Output: A list.\nQuery Complexity: Medium",
        "summary:\nLong " + "w " * 120 + "\nExpected  output: x\nComplexity: very complex.\n",
        "Summary: a\nExpected Output: b\nQuery Complexity: Hard",
        "Summary: a\nQuery Complexity: Simple",
        None,
    ]
    rows = values(
        parse_summary_reply(replies(scripts, *texts)),
        "summary",
        "complexity",
        "n_words",
        "well_formed",
        "within_limit",
        "known_label",
    )
    assert rows[0] == ("Reads rows.", "Medium", 4, True, True, True)
    assert rows[1][1:] == ("Very Complex", 122, True, False, True)
    assert rows[2] == ("a", None, 2, True, True, False)
    assert rows[3] == (None, None, 0, False, True, False)
    assert rows[4] == (None, None, 0, False, True, False)
