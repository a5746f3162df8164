from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scriptloom.operators.classify import classify_scripts, parse_classification, usable
from scriptloom.operators.ingest import apply_translation, first_per_key, new_scripts, registry_rows
from scriptloom.operators.stats import object_type_stats, stmt_type_stats
from scriptloom.operators.translate import translate_registry, translate_table
from scriptloom.operators.worklist import stored_worklist, worklist
from scriptloom.schema import REGISTRY_COLUMNS, REGISTRY_SCHEMA
from scriptloom.sources.registry import (
    add_translations,
    empty_registry,
    latest_version,
    read_registry,
    registry_insert,
    write_snapshot,
)

TS = datetime(2024, 1, 2, 3, 4, 5)


def scanned(spark, rows):
    """(path, body) pairs as a scan with file names."""
    frame = spark.createDataFrame(rows, "path string, sql_body string")
    return frame.select(
        F.element_at(F.split("path", "/"), -1).alias("sql_file_name"),
        "path",
        F.lit("2024-01-01").alias("load_ts"),
        F.md5("sql_body").alias("md5"),
        "sql_body",
    )


def classified(spark, rows):
    return usable(parse_classification(classify_scripts(scanned(spark, rows))))


ROWS = [
    ("s/b/x.sql", "CREATE TABLE dbo.x (a int)"),
    ("s/a/x.sql", "CREATE TABLE dbo.x (a int)"),
    ("s/a/y.sql", "CREATE TABLE dbo.x (a int)"),
    ("s/c/x.sql", "CREATE TABLE dbo.x (a int, b int)"),
    ("s/a/v.sql", "CREATE VIEW v AS SELECT a FROM x"),
    ("s/a/c.sql", "ALTER TABLE x ADD CONSTRAINT c CHECK (a > 0)"),
    ("s/a/g.sql", "GRANT SELECT ON x TO u"),
    ("s/a/q.sql", "hello"),
]


def keys(frame):
    return sorted((r.sql_file_name, r.path) for r in frame.collect())


def test_first_path_wins_per_name_and_content(spark):
    assert keys(first_per_key(classified(spark, ROWS))) == [
        ("c.sql", "s/a/c.sql"),
        ("g.sql", "s/a/g.sql"),
        ("q.sql", "s/a/q.sql"),
        ("v.sql", "s/a/v.sql"),
        ("x.sql", "s/a/x.sql"),
        ("x.sql", "s/c/x.sql"),
        ("y.sql", "s/a/y.sql"),
    ]


def test_insert_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "registry")
    assert latest_version(spark, root) is None
    assert read_registry(spark, root).schema == REGISTRY_SCHEMA
    for rows, total in ((ROWS[:3], 2), (ROWS[:3], 2), (ROWS, 7), (ROWS, 7)):
        fresh = new_scripts(classified(spark, rows), read_registry(spark, root))
        registry_insert(registry_rows(fresh), root)
        stored = read_registry(spark, root)
        assert stored.columns == REGISTRY_COLUMNS
        assert stored.count() == total
    row = stored.where("sql_file_name = 'y.sql'").first()
    assert (row.completion_worked, row.completion_status, row.completion_err_msg) == (
        "Yes",
        "Completed",
        "None",
    )
    assert (row.stmt_type, row.object_type, row.updated_ts) == ("DDL", "table", None)


def registry_of(spark, kinds):
    """A registry of (stmt_type, object_type, operation_type) rows."""
    rows = [
        {
            **dict.fromkeys(REGISTRY_COLUMNS),
            "sql_file_name": f"f{i}",
            "_stg_sql_file_md5": "m",
            "_stg_sql_file_name": f"s/f{i}",
            "sql_body": "CREATE TABLE t(a int)",
            "stmt_type": s,
            "object_type": o,
            "operation_type": p,
        }
        for i, (s, o, p) in enumerate(kinds)
    ]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


ODD_KINDS = [
    ("DDL", "table", "create"),
    ("DDL", "TABLE", "create"),
    ("DDL", "", "create"),
    ("DDL", None, "create"),
    ("DDL", "odd/kind=1", "create"),
    ("ddl", "table", "create"),
    (None, "view", "create"),
    ("DML", None, None),
    ("DDL", "table", "alter"),
]


def test_kinds_survive_storage(spark, tmp_path):
    root = str(tmp_path / "registry")
    registry_insert(registry_of(spark, ODD_KINDS), root)
    stored = sorted(read_registry(spark, root).collect(), key=lambda r: r.sql_file_name)
    assert [(r.stmt_type, r.object_type, r.operation_type) for r in stored] == ODD_KINDS
    assert [r.sql_file_name for r in stored_worklist(spark, root, "table").collect()] == ["f0"]
    assert [r.sql_file_name for r in stored_worklist(spark, root, "constraint").collect()] == ["f8"]
    odd = read_registry(spark, root, "DDL", "odd/kind=1").collect()
    assert [r.sql_file_name for r in odd] == ["f4"]


def test_stats_fold_case_and_keep_null(spark):
    registry = registry_of(spark, ODD_KINDS)
    assert [tuple(r) for r in object_type_stats(registry).collect()] == [
        ("Table", 3),
        (None, 1),
        ("", 1),
        ("Odd/Kind=1", 1),
    ]
    assert [tuple(r) for r in stmt_type_stats(registry).collect()] == [
        ("DDL", 6),
        (None, 1),
        ("DML", 1),
        ("ddl", 1),
    ]


def test_worklist_limits_and_columns(spark):
    registry = registry_of(spark, [("DDL", "table", "create")] * 30)
    assert worklist(registry, "table").count() == 30
    assert worklist(registry, "table", None).count() == 30
    assert worklist(registry, "table", -1).count() == 30
    first = worklist(registry, "table", 3)
    assert [r.sql_file_name for r in first.collect()] == ["f0", "f1", "f10"]
    assert "_stg_sql_file_load_ts" in first.columns
    assert worklist(registry, "view").columns == ["sql_file_name", "_stg_sql_file_md5", "sql_body"]
    with pytest.raises(KeyError):
        worklist(registry, "index")


def test_scan_of_a_kind_reads_its_folder_only(spark, tmp_path, plan):
    root = str(tmp_path / "registry")
    registry_insert(registry_of(spark, ODD_KINDS), root)
    text = plan(stored_worklist(spark, root, "table"))
    assert "(part_object" in text.split("PartitionFilters")[1].split("\n")[0]
    assert "EqualTo(operation_type,create)" in text.split("PushedFilters")[1].split("\n")[0]
    assert "completion_response" not in text.split("ReadSchema")[1].split("\n")[0]


def test_update_touches_matching_rows_only(spark):
    registry = registry_of(spark, [("DDL", "table", "create")] * 3)
    updates = spark.createDataFrame(
        [("f0", "m", "old", "Table", 1), ("f0", "m", "new", "Table", 2), ("f1", "other", "x", "y", 1)],
        "sql_file_name string, _stg_sql_file_md5 string, target_sql string, "
        "target_object_type string, seq int",
    )
    result = apply_translation(registry, updates, TS, order_by="seq")
    assert result.columns == REGISTRY_COLUMNS
    found = sorted((r.sql_file_name, r.target_sql, r.updated_ts) for r in result.collect())
    assert found == [("f0", "new", TS), ("f1", None, None), ("f2", None, None)]


def test_update_of_a_hot_key_is_complete(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("name"), "id"
    )
    registry = rows.select(
        *[
            {
                "sql_file_name": F.col("name"),
                "_stg_sql_file_md5": F.lit("m"),
                "_stg_sql_file_name": F.concat(F.lit("s/"), F.col("id")),
            }
            .get(c, F.lit(None).cast(REGISTRY_SCHEMA[c].dataType))
            .alias(c)
            for c in REGISTRY_COLUMNS
        ]
    )
    updates = rows.select(
        F.col("name").alias("sql_file_name"),
        F.lit("m").alias("_stg_sql_file_md5"),
        F.concat(F.lit("sql of "), F.col("name")).alias("target_sql"),
        F.lit("Table").alias("target_object_type"),
    )
    result = apply_translation(registry, updates, TS, hot_rows=100)
    assert "__salt" in result._jdf.queryExecution().optimizedPlan().toString()
    assert result.count() == 3000
    assert result.where(F.col("target_sql") == F.concat(F.lit("sql of "), "sql_file_name")).count() == 3000


def test_in_place_translation_equals_the_update(spark):
    registry = registry_rows(first_per_key(classified(spark, ROWS)))
    in_place = translate_registry(registry, ["table"], batch_ts=TS)
    updated = apply_translation(registry, translate_table(worklist(registry, "table")), TS)
    assert sorted(map(tuple, in_place.collect()), key=str) == sorted(
        map(tuple, updated.collect()), key=str
    )


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "registry")
    assert write_snapshot(registry_of(spark, ODD_KINDS), root) == 0
    rows = translate_registry(read_registry(spark, root), batch_ts=TS)
    assert write_snapshot(rows, root) == 1
    assert read_registry(spark, root).where("updated_ts is not null").count() == 2
    assert read_registry(spark, root, version=0).where("updated_ts is not null").count() == 0
    # An unfinished version is not read, and the next attempt replaces it.
    (tmp_path / "registry" / "v=2").mkdir()
    assert latest_version(spark, root) == 1
    assert write_snapshot(rows, root) == 2
    assert read_registry(spark, root).count() == len(ODD_KINDS)


def test_recorded_translations(spark, tmp_path):
    root = str(tmp_path / "registry")
    schema = "sql_file_name string, _stg_sql_file_md5 string, target_sql string, target_object_type string"
    one = spark.createDataFrame([("f0", "m", "first", "Table")], schema)
    with pytest.raises(ValueError):
        add_translations(one, root)
    registry_insert(registry_of(spark, ODD_KINDS), root)
    add_translations(one, root, TS)
    later = datetime(2025, 1, 1)
    two = spark.createDataFrame([("f0", "m", "again", None), ("f1", "x", "no", "Table")], schema)
    add_translations(two, root, later)

    def translated(**options):
        rows = read_registry(spark, root, **options).where("updated_ts is not null")
        return [(r.sql_file_name, r.target_sql, r.target_object_type, r.updated_ts) for r in rows.collect()]

    expected = [("f0", "again", None, later)]
    assert translated() == expected
    assert translated(stmt_type="DDL", object_type="table") == expected
    assert translated(translations=False) == []
    assert write_snapshot(read_registry(spark, root), root) == 1
    assert translated() == expected
    assert translated(translations=False) == expected
    assert read_registry(spark, root).count() == len(ODD_KINDS)


def test_empty_registry(spark):
    assert empty_registry(spark).count() == 0
