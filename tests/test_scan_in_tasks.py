"""Scans whose listing stays in tasks, and roots that Spark's readers take."""

import pytest
from pyspark.sql import functions as F

from scriptloom.sources import files as files_source
from scriptloom.sources import stage as stage_source
from scriptloom.sources.files import StageReader
from scriptloom.sources.stage import batch_scripts, preview_scripts, scan_scripts

NAMES = [f"{folder}/{k}-MS-SQL-Server-Script.sql" for folder in ("a", "b", "b/c") for k in range(3)]


@pytest.fixture
def stage(tmp_path):
    for name in NAMES:
        path = tmp_path / "stage" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"SELECT '{name}'")
    return tmp_path / "stage"


def names(frame, stage):
    return sorted(r["path"].removeprefix(f"file:{stage}/") for r in frame.collect())


@pytest.fixture
def no_driver_listing(monkeypatch):
    def refuse(*_):
        raise AssertionError("listed on the driver")

    monkeypatch.setattr(stage_source, "_scan_on_driver", refuse, raising=False)


def test_a_scan_lists_in_tasks(spark, stage, plan, no_driver_listing):
    scan = scan_scripts(spark, str(stage))
    assert "binaryFile" not in plan(scan)
    assert names(scan, stage) == sorted(NAMES)


def test_limits_list_in_tasks(spark, stage, plan, no_driver_listing):
    for found, n in ((preview_scripts(spark, str(stage)), 5), (batch_scripts(spark, str(stage), 7), 7)):
        assert "binaryFile" not in plan(found)
        assert names(found, stage) == sorted(NAMES)[:n]


def test_first_rows_come_to_the_driver_from_few_tasks(spark):
    many = spark.range(0, 1000, 1, 200).select(F.col("id").alias("path"))
    few = stage_source._first(many, "path", 3)
    assert [r["path"] for r in few.collect()] == [0, 1, 2]
    assert few.rdd.context.defaultParallelism < 200
    assert "Coalesce" in few._jdf.queryExecution().toString()


def test_roots_may_overlap_or_have_wildcards(spark, stage):
    assert names(scan_scripts(spark, [str(stage), str(stage / "b")]), stage) == sorted(NAMES)
    assert names(scan_scripts(spark, f"{stage}/{{a,c}}"), stage) == sorted(NAMES)[:3]
    assert names(scan_scripts(spark, f"{stage}/b/*", limit=4), stage) == sorted(NAMES)[3:7]


def test_the_driver_lists_what_tasks_cannot_open(spark, stage, monkeypatch):
    monkeypatch.setattr(stage_source, "can_open", lambda path: False)
    plain = [n.replace("///", "/") for n in names(scan_scripts(spark, str(stage)), stage)]
    assert sorted(n.removeprefix(f"file:{stage}/") for n in plain) == sorted(NAMES)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_scripts(spark, str(stage / "nowhere"))


def test_tasks_share_the_files_of_a_folder(stage, monkeypatch):
    monkeypatch.setattr(files_source, "FOLDER_FILES", 1)
    reader = StageReader({"roots": f'["{stage}"]', "glob": "*.sql"})
    found = [[r["path"] for b in reader.read(p) for r in b.to_pylist()] for p in reader.partitions()]
    assert len(found) > 4
    assert sorted(n.removeprefix(f"file:{stage}/") for part in found for n in part) == sorted(NAMES)


def test_the_driver_reads_no_file_but_its_name(stage, monkeypatch):
    monkeypatch.setattr(files_source, "_entries", None)
    reader = StageReader({"roots": f'["{stage}"]', "glob": "*.sql"})
    assert sorted(p.path.removeprefix("file:") for p in reader.partitions()) == [str(stage / n).rstrip("/") for n in ("", "a", "b", "b/c")]
