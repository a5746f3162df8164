import hashlib
import os

import pytest

from scriptloom.schema import SCRIPT_PATTERN
from scriptloom.sources.stage import (
    batch_scripts,
    preview_scripts,
    scan_scripts,
    tabulate,
    with_file_name,
)

FILES = {
    "a/01-MS-SQL-Server-Script-x.sql": "CREATE TABLE dbo.x (a int)\nGO\n",
    "b/01-MS-SQL-Server-Script-x.sql": "CREATE TABLE dbo.x (a int)\nGO\n",
    "a/other.sql": "not matched",
    "a/MS-SQL-Server-Script.sql.bak": "not matched",
    "it's-MS-SQL-Server-Script.sql": "SELECT 'é'",
    "a b+c%41/MS-SQL-Server-Script [1].sql": "SELECT 1",
    "c/d/e/MS-SQL-Server-Script-empty.sql": "",
}


@pytest.fixture
def stage(tmp_path):
    for name, body in FILES.items():
        path = tmp_path / "stage" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body, encoding="utf-8")
    return tmp_path / "stage"


def matching(stage):
    # A file without content has no record to scan.
    return sorted(
        str(stage / n)
        for n, body in FILES.items()
        if "MS-SQL-Server-Script" in n and n.endswith(".sql") and body
    )


def plain(path):
    return path.removeprefix("file:").replace("///", "/", 1)


def test_scan_reads_every_matching_file_whole(spark, stage):
    rows = {plain(r.path): r for r in scan_scripts(spark, str(stage)).collect()}
    assert sorted(rows) == matching(stage)
    for path, row in rows.items():
        body = FILES[os.path.relpath(path, stage)]
        assert row.sql_body == body
        assert row.md5 == hashlib.md5(body.encode()).hexdigest()
        assert row.load_ts[:2] == "20"


def test_file_names_and_report_columns(spark, stage):
    scanned = with_file_name(scan_scripts(spark, str(stage)))
    names = {r.sql_file_name for r in scanned.collect()}
    assert "it's-MS-SQL-Server-Script.sql" in names
    assert "MS-SQL-Server-Script [1].sql" in names
    assert tabulate(scanned).columns == ["SQL_File_Name", "Load_Time", "MD5", "SQL_Body"]


def test_limits_take_the_first_paths(spark, stage):
    expected = matching(stage)
    assert len(expected) == 4
    found = [plain(r.path) for r in batch_scripts(spark, str(stage), 3).collect()]
    assert sorted(found) == expected[:3]
    assert preview_scripts(spark, str(stage)).count() == 4
    assert batch_scripts(spark, str(stage), None).count() == 4
    assert batch_scripts(spark, str(stage), 2, pattern=".*nothing.*").count() == 0


def test_several_roots_and_own_pattern(spark, stage):
    roots = [str(stage / "a"), str(stage / "b")]
    assert scan_scripts(spark, roots).count() == 2
    assert scan_scripts(spark, roots, pattern=".*/other[.]sql").count() == 1
    assert SCRIPT_PATTERN.endswith("[.]sql")


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-16-be-bom"])
def test_encodings(spark, tmp_path, encoding):
    text = "CREATE TABLE dbo.tä (a int)"
    data = ("\ufeff" + text).encode("utf-16-be") if encoding.endswith("bom") else text.encode(encoding)
    (tmp_path / "x-MS-SQL-Server-Script.sql").write_bytes(data)
    row = scan_scripts(spark, str(tmp_path)).first()
    assert row.sql_body == text and row.md5 == hashlib.md5(data).hexdigest()


def test_load_time_is_in_utc_in_any_zone(spark, tmp_path):
    (tmp_path / "x-MS-SQL-Server-Script.sql").write_text("select 1")
    zone = spark.conf.get("spark.sql.session.timeZone")
    first = scan_scripts(spark, str(tmp_path)).first().load_ts
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert scan_scripts(spark, str(tmp_path)).first().load_ts == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
