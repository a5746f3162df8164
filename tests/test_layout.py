"""How the queries run: no Python per row, no cross joins, no whole columns unread."""

import pytest

from checks.queries import all_queries
from scriptloom.operators import chat
from scriptloom.operators.ingest import new_scripts
from scriptloom.operators.stats import object_type_stats
from scriptloom.operators.translate import translate_registry
from scriptloom.schema import REGISTRY_SCHEMA
from scriptloom.sources.registry import read_registry, registry_insert

SF_DIR = "/root/testdata/sf0.001"
WITH_BACKEND = {"complete", "complete_documents", "complete_translation", "chat_answer"}


@pytest.mark.parametrize("name", sorted(set(all_queries()) - WITH_BACKEND))
def test_queries_stay_in_the_jvm(spark, plan, name):
    text = plan(all_queries()[name](spark, SF_DIR))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "NestedLoop"):
        assert node not in text


def test_new_scripts_are_found_without_bodies(spark, plan):
    scripts = spark.createDataFrame(
        [("a", "s/a", "t", "m", "b")],
        "sql_file_name string, path string, load_ts string, md5 string, sql_body string",
    )
    registry = spark.createDataFrame([], REGISTRY_SCHEMA)
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        text = plan(new_scripts(scripts, registry))
    finally:
        spark.conf.set(conf, before)
    tree = text.split("\n\n")[0]
    # Keys and paths are shuffled to find what is new; bodies only above, for that.
    anti = tree.index("SortMergeJoin LeftAnti")
    assert "SortMergeJoin LeftSemi" in tree[:anti]
    below = {int(line.split("(")[-1].split(")")[0]) for line in tree[anti:].splitlines() if "Exchange" in line}
    details = text.split("\n\n")[1:]
    inputs = [d for d in details if d.strip().startswith(tuple(f"({n}) Exchange" for n in below))]
    assert len(inputs) == len(below) >= 2
    assert not any("sql_body" in d for d in inputs)


def test_bodies_of_new_scripts_are_shuffled_once(spark, plan):
    scripts = spark.createDataFrame(
        [("a", "s/a", "t", "m", "b"), ("a", "s/a", "t", "m", "b"), ("a", "s/b", "t", "m", "b"), ("a", "s/c", "t", None, None)],
        "sql_file_name string, path string, load_ts string, md5 string, sql_body string",
    )
    registry = spark.createDataFrame([], REGISTRY_SCHEMA)
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        fresh = new_scripts(scripts, registry)
        details = plan(fresh).split("\n\n")[1:]
        rows = fresh.collect()
    finally:
        spark.conf.set(conf, before)
    moved = [d for d in details if "Exchange" in d.split("\n")[0] or "Exchange" in d[:20]]
    assert len([d for d in moved if "sql_body" in d]) == 1
    assert sorted((r.path, r.md5) for r in rows) == [("s/a", "m"), ("s/c", None)]


def test_stats_read_the_kinds_only(spark, plan, tmp_path):
    root = str(tmp_path / "registry")
    registry_insert(spark.createDataFrame([], REGISTRY_SCHEMA), root)
    schema = plan(object_type_stats(read_registry(spark, root))).split("ReadSchema")[1].split("\n")[0]
    assert "object_type" in schema and "sql_body" not in schema


def test_prompt_lengths_are_computed_once(spark):
    history = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    frame = chat.chat_prompt(history)
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    # The history is scanned for the lengths and for the pieces; other uses are reused.
    assert final.count("FileScan parquet") == 2
    assert final.count("Reused") >= 1


def test_whole_registry_is_translated_without_shuffle(spark, plan, tmp_path):
    root = str(tmp_path / "registry")
    registry_insert(spark.createDataFrame([], REGISTRY_SCHEMA), root)
    text = plan(translate_registry(read_registry(spark, root)))
    assert "Exchange" not in text


def test_stats_over_unregistered_scripts_leave_the_bodies(spark, plan):
    text = plan(all_queries()["object_type_stats"](spark, SF_DIR))
    assert "SortAggregate" not in text and "min_by" not in text


def test_kinds_are_filtered_before_the_shuffle(spark, plan):
    tree = plan(all_queries()["worklist_view"](spark, SF_DIR)).split("\n\n")[0]
    assert "Filter" not in tree[: tree.index("Exchange")]
    assert "Filter" in tree[tree.index("Exchange") :]


def test_pending_is_a_hash_aggregate(spark, plan):
    history = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    text = plan(chat.chat_pending(history))
    assert "SortAggregate" not in text
    assert "text" not in text.split("ReadSchema")[1].split("\n")[0]
