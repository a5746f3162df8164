"""Stages listed and read in tasks; files that have not changed are not opened again."""

import os

import pytest

from scriptloom.plans.onboarding import onboard
from scriptloom.sources import files as files_source
from scriptloom.sources.files import StageReader, list_files, read_files
from scriptloom.sources.manifest import changed_files, read_manifest
from scriptloom.sources.registry import read_registry
from scriptloom.sources.stage import list_scripts, scan_in_tasks, scan_scripts

FILES = {
    "a/01-MS-SQL-Server-Script-t.sql": "CREATE TABLE [dbo].[t] (a varchar(3))",
    "b/01-MS-SQL-Server-Script-t.sql": "CREATE TABLE [dbo].[t] (a varchar(3))",
    "b/c/d/02-MS-SQL-Server-Script-v.sql": "CREATE VIEW dbo.v AS SELECT a FROM dbo.t",
    "03-MS-SQL-Server-Script-it's.sql": "INSERT INTO t VALUES ('é')",
    "a b+c%41/MS-SQL-Server-Script [1].sql": "GRANT SELECT ON t TO u",
    "a/other.sql": "not matched",
    "_hidden/04-MS-SQL-Server-Script-h.sql": "SELECT 1",
    "a/.05-MS-SQL-Server-Script-h.sql": "SELECT 1",
    "a/06-MS-SQL-Server-Script-empty.sql": "",
}


@pytest.fixture
def stage(tmp_path):
    def write(files):
        for name, body in files.items():
            path = tmp_path / "stage" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(body, encoding="utf-8")
        return str(tmp_path / "stage")

    return write


def test_scan_in_tasks_equals_the_scan(spark, stage):
    root = stage(FILES)
    want = sorted(map(tuple, scan_scripts(spark, root).collect()))
    assert len(want) == 5
    assert sorted(map(tuple, scan_in_tasks(spark, root).collect())) == want
    roots = [root + "/a", "file://" + root + "/b"]
    assert scan_in_tasks(spark, roots).count() == scan_scripts(spark, roots).count() == 3


@pytest.mark.parametrize("folders", [1, 2, 4, 1000])
def test_partitions_are_folders_and_cover_each_file_once(spark, stage, folders):
    root = stage(FILES)
    reader = StageReader({"roots": f'["{root}"]', "glob": "*.sql", "folders": str(folders)})
    parts = reader.partitions()
    assert all(os.path.isdir(p.path.removeprefix("file:")) for p in parts)
    assert len(parts) == 1 if folders == 1 else len(parts) > 1
    found = [path for p in parts for batch in reader.read(p) for path in batch.column("path").to_pylist()]
    assert len(found) == len(set(found)) == 6
    assert list_files(spark, root, "*.sql", folders).count() == 6


def test_a_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        list_files(spark, str(tmp_path / "nowhere")).collect()


def test_contents_are_read_in_bounded_batches(spark, stage, monkeypatch):
    root = stage({f"x/MS-SQL-Server-Script-{k}.sql": "x" * (k + 1) for k in range(30)})
    monkeypatch.setattr(files_source, "BATCH_BYTES", 40)
    got = {r["path"][-6:]: len(r["content"]) for r in read_files(list_files(spark, root)).collect()}
    assert sorted(got.values()) == list(range(1, 31))


def counted(spark, *args, **options):
    counter = spark.sparkContext.accumulator(0)
    onboard(spark, *args, opened=counter, **options)
    return counter.value


def test_an_unchanged_stage_is_not_opened(spark, stage, tmp_path):
    root, registry = stage(FILES), str(tmp_path / "registry")
    assert counted(spark, root, registry) == 5
    first = sorted(map(str, read_registry(spark, registry).collect()))
    assert counted(spark, root, registry) == 0
    assert sorted(map(str, read_registry(spark, registry).collect())) == first and len(first) == 4
    assert read_manifest(spark, registry).count() == 5
    stage({"a/01-MS-SQL-Server-Script-t.sql": "CREATE TABLE [dbo].[t] (a int)", "a/07-MS-SQL-Server-Script-n.sql": "SELECT 1"})
    assert counted(spark, root, registry) == 2
    assert read_registry(spark, registry).count() == 6
    assert counted(spark, root, registry) == 0


def test_what_a_limit_leaves_out_is_read_again(spark, stage, tmp_path):
    root, registry = stage(FILES), str(tmp_path / "registry")
    counted(spark, root, registry, limit=2)
    assert read_registry(spark, registry).count() == 2
    left = changed_files(list_scripts(spark, root), registry).count()
    assert counted(spark, root, registry) == left > 0
    assert read_registry(spark, registry).count() == 4
    assert counted(spark, root, registry) == 0


def test_failed_scripts_are_read_again(spark, stage, tmp_path):
    root, registry = stage(FILES), str(tmp_path / "registry")

    def refuses():
        return lambda prompts: ["no JSON" for _ in prompts]

    assert counted(spark, root, registry, backend=refuses) == 5
    assert read_registry(spark, registry).count() == 0 and read_manifest(spark, registry).count() == 0
    assert counted(spark, root, registry) == 5
    assert read_registry(spark, registry).count() == 4


def test_an_empty_stage(spark, tmp_path):
    (tmp_path / "stage").mkdir()
    assert counted(spark, str(tmp_path / "stage"), str(tmp_path / "registry")) == 0
    assert read_registry(spark, str(tmp_path / "registry")).count() == 0
