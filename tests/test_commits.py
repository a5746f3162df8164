"""Writers at once: whole commits, nothing lost, nothing twice."""

import threading

import pytest

from scriptloom.plans.migration import migrate_all
from scriptloom.schema import REGISTRY_COLUMNS, REGISTRY_SCHEMA
from scriptloom.operators.stats import object_type_stats, stmt_type_stats
from scriptloom.sources import registry as R
from scriptloom.sources.commits import INSERT, Commit, ConflictError, _rename, commits, head, put
from scriptloom.sources.registry import (
    add_translations,
    drop_versions,
    read_inventory,
    read_registry,
    registry_insert,
    write_snapshot,
)

UPDATES = "sql_file_name string, _stg_sql_file_md5 string, target_sql string, target_object_type string"


def scripts(spark, numbers):
    rows = [
        {
            **dict.fromkeys(REGISTRY_COLUMNS), "sql_file_name": f"f{i}", "_stg_sql_file_md5": "m",
            "sql_body": "CREATE TABLE t(a int)", "stmt_type": "DDL", "object_type": "table", "operation_type": "create",
        }
        for i in numbers
    ]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def names(spark, root, **options):
    return sorted(int(r.sql_file_name[1:]) for r in read_registry(spark, root, **options).collect())


def test_a_number_is_taken_once(spark, tmp_path):
    root = str(tmp_path)
    assert head(spark, root) == -1 and commits(spark, root) == []
    assert put(spark, root, Commit(0, INSERT, 0, "v=0/a"))
    assert not put(spark, root, Commit(0, INSERT, 0, "v=0/b"))
    assert [c.folder for c in commits(spark, root)] == ["v=0/a"] and head(spark, root) == 0
    assert sorted(p.name for p in (tmp_path / "commits").glob("*")) == [f"{0:020d}.json"]


def test_a_rename_fails_where_a_record_is(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).write_text(name)
    path = spark._jvm.org.apache.hadoop.fs.Path
    _rename(spark, path(str(tmp_path / "one")), path(str(tmp_path / "three")))
    with pytest.raises(Exception, match="exists"):
        _rename(spark, path(str(tmp_path / "two")), path(str(tmp_path / "three")))
    assert (tmp_path / "three").read_text() == "one"


def test_overlapping_inserts_from_the_same_state(spark, tmp_path):
    root = str(tmp_path / "registry")
    registry_insert(scripts(spark, range(3)), root)
    since = head(spark, root)
    registry_insert(scripts(spark, range(3, 8)), root, since)
    registry_insert(scripts(spark, range(5, 12)), root, since)
    assert names(spark, root) == list(range(12))


def test_sessions_insert_at_once(spark, tmp_path):
    root = str(tmp_path / "registry")
    gate, errors = threading.Barrier(4), []

    def insert(session, low):
        try:
            frame = scripts(session, range(low, low + 10))
            gate.wait()
            registry_insert(frame, root, -1)
        except Exception as error:  # pragma: no cover
            errors.append(error)

    threads = [threading.Thread(target=insert, args=(spark.newSession(), 5 * k)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert names(spark, root) == list(range(25))
    assert [c.number for c in commits(spark, root)] == [0, 1, 2, 3]


def test_a_killed_insert_is_invisible(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "registry")
    registry_insert(scripts(spark, range(3)), root)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(R, "put", killed)
    with pytest.raises(KeyboardInterrupt):
        registry_insert(scripts(spark, range(3, 6)), root)
    monkeypatch.undo()
    assert len(list((tmp_path / "registry" / "v=0").iterdir())) == 2
    assert names(spark, root) == [0, 1, 2]
    registry_insert(scripts(spark, range(3, 6)), root)
    assert names(spark, root) == list(range(6))


def test_a_reader_keeps_what_it_read(spark, tmp_path):
    root = str(tmp_path / "registry")
    registry_insert(scripts(spark, range(3)), root)
    before = read_registry(spark, root)
    registry_insert(scripts(spark, range(3, 6)), root)
    assert before.count() == 3 and read_registry(spark, root).count() == 6


def test_a_snapshot_does_not_lose_an_insert(spark, tmp_path):
    root = str(tmp_path / "registry")
    registry_insert(scripts(spark, range(3)), root)
    since, rows = head(spark, root), read_registry(spark, root)
    registry_insert(scripts(spark, range(3, 5)), root)
    with pytest.raises(ConflictError):
        write_snapshot(rows, root, since=since)
    assert names(spark, root) == list(range(5)) and not list((tmp_path / "registry" / "v=1").iterdir())
    assert migrate_all(spark, root) == 1
    assert names(spark, root) == list(range(5))


def test_migration_starts_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "registry")
    registry_insert(scripts(spark, range(3)), root)
    write, tries = R._write, []

    def disturbed(rows, path, mode, rebalance):
        write(rows, path, mode, rebalance)
        if "v=1" in path and not tries:
            tries.append(path)
            registry_insert(scripts(spark, [7]), root)

    monkeypatch.setattr(R, "_write", disturbed)
    assert migrate_all(spark, root) == 1
    assert names(spark, root) == [0, 1, 2, 7]
    assert read_registry(spark, root).where("target_sql is null").count() == 0


def test_inserts_and_translations_follow_a_snapshot(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "registry")
    registry_insert(scripts(spark, range(3)), root)
    since = head(spark, root)
    assert write_snapshot(read_registry(spark, root), root) == 1
    assert registry_insert(scripts(spark, range(2, 6)), root, since) == 1
    assert names(spark, root) == list(range(6)) and names(spark, root, version=0) == [0, 1, 2]
    one = spark.createDataFrame([("f4", "m", "text", "Table")], UPDATES)
    real, seen = R.latest_version, []

    def late(session, where):
        found = real(session, where)
        if not seen:
            seen.append(found)
            write_snapshot(read_registry(spark, root), root)
        return found

    monkeypatch.setattr(R, "latest_version", late)
    assert add_translations(one, root) == 2
    assert [r.sql_file_name for r in read_registry(spark, root).where("target_sql = 'text'").collect()] == ["f4"]


def test_the_inventory_is_kept_without_reading_rows(spark, tmp_path, plan):
    root = str(tmp_path / "registry")
    assert read_inventory(spark, root).count() == 0

    def agrees():
        kept = read_inventory(spark, root)
        assert "/counts/" in plan(kept) and "/v=" not in plan(kept).replace("/counts/v=", "")
        for stats in (object_type_stats, stmt_type_stats):
            assert stats(kept, "n").collect() == stats(read_registry(spark, root)).collect() != []

    registry_insert(scripts(spark, range(5)), root)
    agrees()
    since = head(spark, root)
    registry_insert(scripts(spark, range(5, 9)), root)
    registry_insert(scripts(spark, range(7, 12)), root, since)
    agrees()
    add_translations(spark.createDataFrame([("f4", "m", "text", "Table")], UPDATES), root)
    agrees()
    assert migrate_all(spark, root) == 1
    registry_insert(scripts(spark, [20]), root)
    agrees()
    drop_versions(spark, root, 1)
    agrees()
    assert sorted(p.name for p in (tmp_path / "registry" / "counts").iterdir()) == ["v=1"]
