"""Order of creation of views: levels, cycles, hubs."""

import random

import pytest
from pyspark.sql import functions as F

from scriptloom.operators import levels as L
from scriptloom.operators.levels import view_levels
from scriptloom.operators.stored import Stored

VIEWS = "sql_file_name string, _stg_sql_file_md5 string, schema_name string, object_name string, sql_body string"


def views(spark, graph):
    """A view script for each (schema.name, sources)."""
    rows = []
    for k, (name, sources) in enumerate(graph):
        schema, _, bare = name.rpartition(".")
        body = f"CREATE VIEW {name} AS SELECT a FROM dbo.some_table" + "".join(f" JOIN {s} ON 1 = 1" for s in sources)
        rows.append((f"f{k}.sql", f"m{k}", schema or None, bare, body))
    return spark.createDataFrame(rows, VIEWS)


def levels(spark, graph, **options):
    got = view_levels(views(spark, graph), **options).collect()
    assert len(got) == len(graph)
    return {r["sql_file_name"]: (r["level"], r["in_cycle"]) for r in got}


def plain(graph):
    """(level, in_cycle) of each name, by walking."""
    reads = {}
    for name, sources in graph:
        reads.setdefault(name, set()).update(sources)
    reads = {n: {s for s in own if s in reads} for n, own in reads.items()}

    def reached(name):
        seen, todo = set(), list(reads[name])
        while todo:
            one = todo.pop()
            if one not in seen:
                seen.add(one)
                todo.extend(reads[one])
        return seen

    far = {n: reached(n) for n in reads}
    cyclic = {n for n in reads if n in far[n]}
    found = {}

    def level(name):
        if name not in found:
            found[name] = max((level(s) + 1 for s in reads[name]), default=0)
        return found[name]

    return {n: (None if n in cyclic or far[n] & cyclic else level(n), n in cyclic) for n in reads}


def test_names_schemas_and_missing_sources(spark):
    graph = [("dbo.a", []), ("b", ["[dbo].[A]", "nowhere"]), ("sales.a", ["dbo.b"]), ("c", ["sales.a", "a"]), ("d", ["other.a"])]
    got = levels(spark, graph)
    assert got == {"f0.sql": (0, False), "f1.sql": (1, False), "f2.sql": (2, False), "f3.sql": (3, False), "f4.sql": (0, False)}


def test_scripts_of_one_name_share_their_level(spark):
    got = levels(spark, [("a", []), ("b", ["a"]), ("a", ["c"]), ("c", [])])
    assert got == {"f0.sql": (1, False), "f1.sql": (2, False), "f2.sql": (1, False), "f3.sql": (0, False)}


def test_cycles_and_what_reads_them(spark):
    graph = [
        ("self", ["self"]), ("a", ["b"]), ("b", ["c", "t"]), ("c", ["a"]), ("above", ["a"]), ("top", ["above", "x"]),
        ("x", ["y"]), ("y", ["x"]), ("between", ["x"]), ("z", ["between", "z2"]), ("z2", ["z"]), ("t", []),
    ]
    want = plain(graph)
    got = levels(spark, graph)
    assert {n: got[f"f{k}.sql"] for k, (n, _) in enumerate(graph)} == want
    assert want["between"] == (None, False) and want["z"] == (None, True) and want["t"] == (0, False)


@pytest.mark.parametrize("seed", [1, 2])
def test_graphs_at_random(spark, seed):
    rng = random.Random(seed)
    names = [f"v{k}" for k in range(40)]
    graph = [(n, rng.sample(names, rng.choice([0, 1, 1, 2]))) for n in names]
    got = levels(spark, graph)
    assert {n: got[f"f{k}.sql"] for k, (n, _) in enumerate(graph)} == plain(graph)


def test_a_chain_of_two_hundred(spark):
    names = spark.range(200).select(F.format_string("V%03d", "id").alias("name"))
    edges = spark.range(1, 200).select(
        F.format_string("V%03d", "id").alias("name"), F.format_string("V%03d", F.col("id") - 1).alias("reads")
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found, left = L._peel(names, edges, [], Stored())
        assert {r["name"]: r["level"] for r in found.collect()} == {f"V{k:03d}": k for k in range(200)}
        assert left.isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_hub_is_spread_over_tasks(spark, plan):
    graph = [("hub", [])] + [(f"v{k}", ["hub"] if k % 3 == 0 else []) for k in range(300)]
    got = levels(spark, graph, hot_rows=20)
    assert sum(level == 1 for level, _ in got.values()) == 100
    edges = spark.createDataFrame([(f"V{k}", "HUB") for k in range(100)], "name string, reads string")
    hot = L.hot_key_hashes(edges, ["reads"], 20)
    met = L._met(edges, spark.createDataFrame([("HUB", True)], "reads string, met boolean"), hot, "met")
    assert len(hot) == 1 and met.where("met").count() == 100
    assert "__salt" in plan(met)


def test_empty(spark):
    assert view_levels(views(spark, [("a", [])]).where("false")).collect() == []
