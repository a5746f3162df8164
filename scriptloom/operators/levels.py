"""In which order views can be created: each after the views it reads.

Levels are peeled off in rounds. A round joins the edges that are left with what the round
before has settled; views all of whose edges are met are settled next. What is left when a
round settles nothing leads into a cycle. Cycles are told from what only reads them by the
greatest name each view leads to: views that share it and are reached from it in turn read
each other.

Every round's tables are stored. Names that very many views read are joined over salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.operators.lineage import with_sources
from scriptloom.operators.skew import HOT_ROWS, hot_key_hashes, salted_left_join
from scriptloom.operators.stored import Stored
from scriptloom.schema import KEY


def view_name(schema: Column, name: Column) -> Column:
    """A view's name as the scripts that read it have it: upper case, without `dbo`."""
    schema = F.upper(schema)
    return F.concat(F.when(schema.isNotNull() & (schema != "DBO"), F.concat(schema, F.lit("."))).otherwise(""), F.upper(name))


def view_levels(views: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Key, schema_name, object_name, level and in_cycle of each view script.

    A view that reads no other view has level 0, another one more than the highest level it
    reads; views of a level can be created together. One that reads itself, directly or not,
    is `in_cycle`; it and all that lead to it have no level. Views are taken by name: scripts
    that create the same one share its level, which all their sources count for. Names
    without a script, such as tables, do not count. A view without a name has no level.
    """
    stored = Stored()
    scripts = with_sources(views)
    name = view_name(F.col("schema_name"), F.col("object_name")).alias("name")
    scripts = stored(scripts.select(*KEY, "schema_name", "object_name", name, "sources"), "levels-scripts")
    nodes = stored(scripts.select("name").where("name is not null").distinct(), "levels-nodes")
    edges = scripts.where("name is not null").select("name", F.explode("sources").alias("reads")).distinct()
    edges = stored(edges, "levels-sources")
    # The hub of most edges stays the same as they grow fewer.
    hot = hot_key_hashes(edges, ["reads"], hot_rows)
    known = nodes.select(F.col("name").alias("reads"), F.lit(True).alias("found"))
    between = _met(edges, known, hot, "found").where("found").select("name", "reads")
    between = stored(between, "levels-edges")
    levels, left = _peel(nodes, between, hot, stored)
    cycles = _in_cycles(left, hot, stored)
    found = levels.unionByName(cycles, allowMissingColumns=True).groupBy("name")
    found = found.agg(F.max("level").alias("level"), F.coalesce(F.max("in_cycle"), F.lit(False)).alias("in_cycle"))
    found = stored(found, "levels-found")
    stored.drop(nodes, edges, between, left)
    same = hot_key_hashes(scripts, ["name"], hot_rows)
    placed = salted_left_join(scripts, found, ["name"], same, KEY)
    return placed.select(
        *KEY, "schema_name", "object_name", "level", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle")
    )


def _met(edges: DataFrame, names: DataFrame, hot: list[int], flag: str) -> DataFrame:
    """The edges with `flag` set where their target is among the names."""
    joined = salted_left_join(edges, names, ["reads"], hot, ["name"])
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))


def _peel(nodes: DataFrame, edges: DataFrame, hot: list[int], stored: Stored) -> tuple[DataFrame, DataFrame]:
    """(name, level) of all views that lead into no cycle, and the edges of the others."""
    reading = edges.select("name").distinct()
    settled = stored(nodes.join(reading, "name", "left_anti").select("name"), "levels-round")
    levels = settled.select("name", F.lit(0).cast("long").alias("level"))
    left, level = edges, 0
    while not settled.isEmpty():
        level += 1
        done = settled.select(F.col("name").alias("reads"), F.lit(True).alias("met"))
        checked = stored(_met(left, done, hot, "met"), "levels-checked")
        if left is not edges:
            stored.drop(left)
        ready = checked.groupBy("name").agg(F.min("met").alias("met")).where("met").select("name")
        settled = stored(ready, "levels-round")
        levels = levels.unionByName(settled.select("name", F.lit(level).cast("long").alias("level")))
        left = stored(checked.where("not met").select("name", "reads"), "levels-left")
        stored.drop(checked)
    return levels, left


def _in_cycles(edges: DataFrame, hot: list[int], stored: Stored) -> DataFrame:
    """(name, in_cycle): the views of these edges that read themselves, directly or not."""
    found = edges.where("false").select("name", F.lit(True).alias("in_cycle"))
    while not edges.isEmpty():
        tops = _greatest_reached(edges, hot, stored)
        # Edges within one greatest name, and the views that are reached from it by them.
        of = tops.select(F.col("name").alias("reads"), F.col("top").alias("to"))
        inner = salted_left_join(edges, of, ["reads"], hot, ["name"]).join(tops, "name")
        inner = stored(inner.where("top = to").select("name", "reads"), "levels-inner")
        reached = tops.where("name = top").select("name")
        reached = delta = stored(reached, "levels-reached")
        while True:
            onward = inner.join(delta, "name", "left_semi").select(F.col("reads").alias("name")).distinct()
            delta = stored(onward.join(reached, "name", "left_anti"), "levels-delta")
            if delta.isEmpty():
                break
            reached = stored(reached.unionByName(delta), "levels-reached")
        # A component of one view is a cycle only if the view reads itself.
        members = stored(reached.join(tops, "name"), "levels-members")
        sizes = members.groupBy("top").agg(F.count(F.lit(1)).alias("n"))
        itself = inner.where("name = reads").select("name", F.lit(True).alias("itself")).distinct()
        cyclic = members.join(sizes, "top").join(itself, "name", "left").where("n > 1 or itself")
        found = found.unionByName(stored(cyclic.select("name", F.lit(True).alias("in_cycle")), "levels-cyclic"))
        gone = members.select("name", F.lit(True).alias("gone"))
        rest = edges.join(gone, "name", "left_anti")
        rest = _met(rest, gone.withColumnRenamed("name", "reads"), hot, "gone").where("not gone").select("name", "reads")
        # What read only such views leads into no other cycle.
        rest = stored(rest, "levels-rest")
        nodes = rest.select("name").unionByName(rest.select(F.col("reads").alias("name"))).distinct()
        _, edges = _peel(nodes, rest, hot, stored)
    return found


def _greatest_reached(edges: DataFrame, hot: list[int], stored: Stored) -> DataFrame:
    """(name, top): the greatest name that each view leads to, itself included."""
    nodes = edges.select("name").unionByName(edges.select(F.col("reads").alias("name"))).distinct()
    tops = delta = stored(nodes.select("name", F.col("name").alias("top")), "levels-tops")
    while not delta.isEmpty():
        of = delta.select(F.col("name").alias("reads"), F.col("top").alias("to"))
        told = salted_left_join(edges, of, ["reads"], hot, ["name"]).where("to is not null")
        told = told.groupBy("name").agg(F.max("to").alias("to"))
        moved = stored(
            tops.join(told, "name", "left").select(
                "name", F.greatest("top", "to").alias("top"), F.coalesce(F.col("to") > F.col("top"), F.lit(False)).alias("new")
            ),
            "levels-tops",
        )
        stored.drop(tops)
        tops, delta = moved, moved.where("new").select("name", "top")
    return tops.select("name", "top")
