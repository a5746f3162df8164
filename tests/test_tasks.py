import pytest

from scriptloom.functions.prompts import TEMPLATES
from scriptloom.operators.lineage import parse_dependency_reply
from scriptloom.operators.tasks import SERVICE_ONLY, answer_task


@pytest.mark.parametrize("task", sorted(set(TEMPLATES) - set(SERVICE_ONLY)))
def test_rules_answer(scripts, task):
    rows = answer_task(scripts("CREATE TABLE t(a int)"), task)
    assert rows.columns == ["sql_file_name", "_stg_sql_file_md5", "response", "error"]
    assert rows.first().error is None


def test_rule_replies_can_be_parsed(scripts):
    views = scripts("create view v as select a from dbo.t join u on 1=1", "create view w as select 1")
    replies = answer_task(views, "view_dependency")
    found = sorted((r.sql_file_name, r.position, r.depends_on) for r in parse_dependency_reply(replies).collect())
    assert found == [("f000.sql", 1, "T"), ("f000.sql", 2, "U")]


def test_load_statement_of_translated_ddl(scripts):
    assert answer_task(scripts("CREATE OR REPLACE TABLE S.T(A INT)"), "copy").first().response == (
        "COPY INTO S.T FROM @DATA_STG/T.csv FILE_FORMAT = (TYPE = CSV) ON_ERROR = CONTINUE;"
    )


def test_a_backend_is_preferred(scripts, tmp_path):
    def backend():
        return lambda prompts: [str(p.count("<context>")) for p in prompts]

    rows = answer_task(scripts("select 1"), "view_summary", backend, str(tmp_path / "ledger"))
    assert [r.response for r in rows.collect()] == ["1"]


@pytest.mark.parametrize("task", [*SERVICE_ONLY, "unknown"])
def test_no_rule(scripts, task):
    with pytest.raises(ValueError):
        answer_task(scripts("x"), task)
