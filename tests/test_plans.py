import json

import pytest

from scriptloom.plans.migration import follow_up, migrate_all, migrate_worklist
from scriptloom.plans.onboarding import onboard
from scriptloom.session import work_dir
from scriptloom.sources.registry import read_registry

FILES = {
    "a/01-MS-SQL-Server-Script-t.sql": "CREATE TABLE [dbo].[t] (a varchar(3))",
    "b/01-MS-SQL-Server-Script-t.sql": "CREATE TABLE [dbo].[t] (a varchar(3))",
    "a/02-MS-SQL-Server-Script-v.sql": "CREATE VIEW dbo.v AS SELECT a, b FROM dbo.t",
    "a/03-MS-SQL-Server-Script-it's.sql": "ALTER TABLE dbo.t ADD CONSTRAINT c CHECK (a > 'x')",
    "a/04-MS-SQL-Server-Script-f.sql": "CREATE FUNCTION f(@a int) RETURNS int AS BEGIN RETURN @a END",
    "a/05-MS-SQL-Server-Script-g.sql": "CREATE TRIGGER dbo.g ON dbo.t AFTER INSERT AS SELECT 1",
    "a/06-MS-SQL-Server-Script-i.sql": "INSERT INTO t VALUES (1)",
}


@pytest.fixture
def stage(tmp_path):
    def write(files):
        for name, body in files.items():
            path = tmp_path / "stage" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(body)
        return str(tmp_path / "stage")

    return write


def test_onboard_then_migrate(spark, stage, tmp_path):
    root, registry = stage(FILES), str(tmp_path / "registry")
    run = onboard(spark, root, registry)
    assert run.version == 0 and run.rejects.count() == 0
    assert read_registry(spark, registry).count() == 6
    onboard(spark, root, registry)
    assert read_registry(spark, registry).count() == 6
    stage({"a/01-MS-SQL-Server-Script-t.sql": "CREATE TABLE [dbo].[t] (a int)"})
    onboard(spark, root, registry)
    assert read_registry(spark, registry).count() == 7

    assert migrate_worklist(spark, registry, "table", limit=1) == 0
    assert read_registry(spark, registry).where("target_sql is not null").count() == 1
    assert migrate_all(spark, registry, ["view"]) == 1
    assert read_registry(spark, registry).where("target_sql is not null").count() == 2
    assert migrate_all(spark, registry) == 2
    rows = {r.sql_file_name[:2]: r for r in read_registry(spark, registry).collect()}
    assert rows["02"].target_sql == "CREATE OR REPLACE VIEW V AS SELECT\n    A,\n    B\nFROM T"
    assert rows["03"].target_sql == "ALTER TABLE T ADD CONSTRAINT C CHECK (A > 'x')"
    assert rows["04"].target_object_type == "Function"
    assert rows["05"].target_object_type == "Task"
    assert rows["06"].target_sql is None and rows["06"].updated_ts is None
    assert migrate_all(spark, registry, ["constraint"], compat=True) == 3
    assert read_registry(spark, registry).where("target_object_type = 'None'").count() == 0
    assert migrate_all(spark, registry, ["constraint"], True, overwrite=True, keep_versions=2) == 4
    assert sorted(p.name for p in (tmp_path / "registry").glob("v=*")) == ["v=3", "v=4"]
    assert read_registry(spark, registry).where("target_object_type = 'None'").count() == 1
    with pytest.raises(ValueError):
        migrate_worklist(spark, registry, "index")


def test_backend_runs(spark, stage, tmp_path):
    def backend():
        def answer(prompts):
            replies = []
            for prompt in prompts:
                if "VIEW" in prompt.split("<context>")[1]:
                    replies.append("Sure! Here is the JSON")
                elif "Answer with one JSON object" in prompt:
                    keys = ["stmt_type", "object_type", "operation_type", "schema_name", "object_name"]
                    replies.append(json.dumps(dict(zip(keys, ["DDL", "table", "create", None, "t"]))))
                else:
                    replies.append("TRANSLATED")
            return replies

        return answer

    root, registry = stage(FILES), str(tmp_path / "registry")
    ledger = str(tmp_path / "ledger")
    run = onboard(spark, root, registry, backend=backend, ledger=ledger)
    assert [(r.sql_file_name[:2], r.reason) for r in run.rejects.collect()] == [
        ("02", "not a JSON object")
    ]
    assert read_registry(spark, registry).where("object_type = 'table'").count() == 5
    migrate_worklist(spark, registry, "table", backend=backend, ledger=ledger)
    assert read_registry(spark, registry).where("target_sql = 'TRANSLATED'").count() == 5


def test_limit_of_one_run(spark, stage, tmp_path):
    registry = str(tmp_path / "registry")
    onboard(spark, stage(FILES), registry, limit=2)
    names = sorted(r.sql_file_name[:2] for r in read_registry(spark, registry).collect())
    assert names == ["01", "02"]
    # Each run with a limit goes on where the last one ended.
    onboard(spark, str(tmp_path / "stage"), registry, limit=2)
    names = sorted(r.sql_file_name[:2] for r in read_registry(spark, registry).collect())
    assert names == ["01", "02", "03", "04"]


def test_worklists_with_a_limit_make_progress(spark, stage, tmp_path):
    registry = str(tmp_path / "registry")
    files = {f"a/0{i}-MS-SQL-Server-Script-t.sql": f"create table t{i} (a int)" for i in range(4)}
    onboard(spark, stage(files), registry)
    for done in (2, 4, 4):
        migrate_worklist(spark, registry, "table", limit=2)
        assert read_registry(spark, registry).where("target_sql is not null").count() == done


def test_rules_leave_recorded_translations_and_marks(spark, stage, tmp_path):
    registry = str(tmp_path / "registry")
    files = {
        "a/1-MS-SQL-Server-Script.sql": "create view v as select a from t",
        "a/2-MS-SQL-Server-Script.sql": "create trigger g on t after insert, bogus as select 1",
        "a/3-MS-SQL-Server-Script.sql": "create table t (a int default newid())",
    }
    onboard(spark, stage(files), registry)
    answer = lambda: lambda prompts: ["BY SERVICE" for _ in prompts]
    migrate_worklist(spark, registry, "view", backend=answer)
    migrate_all(spark, registry)
    rows = {r.sql_file_name[0]: r for r in read_registry(spark, registry).collect()}
    assert rows["1"].target_sql == "BY SERVICE" and rows["1"].needs_review is None
    assert rows["2"].target_sql is None and rows["2"].updated_ts is None and rows["2"].needs_review
    assert rows["3"].target_sql and rows["3"].needs_review
    migrate_all(spark, registry, overwrite=True)
    rows = {r.sql_file_name[0]: r for r in read_registry(spark, registry).collect()}
    assert rows["1"].target_sql.startswith("CREATE OR REPLACE VIEW V") and rows["1"].needs_review is False


def test_work_folder_is_the_shared_one(spark):
    assert work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert work_dir(spark, "x") != work_dir(spark, "x")


def test_follow_ups_and_failures(spark, stage, tmp_path):
    registry = str(tmp_path / "registry")
    files = {
        "a/1-MS-SQL-Server-Script.sql": "create table dbo.t (a int)",
        "a/2-MS-SQL-Server-Script.sql": "create view v as select a from t, u",
        "a/3-MS-SQL-Server-Script.sql": "create trigger g on t after insert as select 1",
    }
    onboard(spark, stage(files), registry)
    migrate_all(spark, registry)
    load = follow_up(spark, registry, "table").collect()
    assert [(r.task, r.response[:12]) for r in load] == [("copy", "COPY INTO T ")]
    assert [(r.task, r.response) for r in follow_up(spark, registry, "view").collect()] == [("view_dependency", "1. T\n2. U")]
    with pytest.raises(ValueError):
        follow_up(spark, registry, "trigger")
    backend = lambda: lambda prompts: ["said" for _ in prompts]
    ledger = str(tmp_path / "ledger")
    assert {r.task for r in follow_up(spark, registry, "view", backend, ledger).collect()} == {"view_dependency", "view_summary"}
    assert [r.response for r in follow_up(spark, registry, "trigger", backend, ledger).collect()] == ["said"]

    other = str(tmp_path / "other")
    run = onboard(spark, str(tmp_path / "stage"), other, backend=lambda: lambda prompts: ["no JSON" for _ in prompts])
    failed = run.failed.collect()
    assert len(failed) == 3 and read_registry(spark, other).count() == 0
    assert {(r.completion_worked, r.completion_status, r.completion_err_msg) for r in failed} == {("No", "Failed", "not a JSON object")}
