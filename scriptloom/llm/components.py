"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import remove, stored

MOST_ROUNDS = 100
#: Links that one task may finish: 16 MB, whatever the corpus. With more there are rounds.
FINISH_LINKS = 1 << 20


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all links of a task."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    node, place = np.unique(
        np.concatenate([table.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True
    )
    a, b = place[: table.num_rows], place[table.num_rows :]
    root = np.arange(len(node))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), long; root is its component's least node.

    Each round hangs the neighbours of a node on the least of them. The minimum of a node's
    neighbours is pre-aggregated and joined back, so a node with very many links meets in no
    single task. Rounds end when nothing changes, or when so few links are left that one task
    finishes them; they grow with the logarithm of the longest path. Links of a node with itself and repeated ones do nothing; nulls are left out.
    """
    spark = links.sparkSession
    edges, path = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "components",
    )
    before = None
    for _ in range(MOST_ROUNDS):
        if edges.count() <= FINISH_LINKS:
            return edges.coalesce(1).mapInArrow(_finish, "node long, root long")
        # Large star: neighbours above a node hang on the least around it.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, least_path = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "components-least")
        large, large_path = stored(
            both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            "components-large",
        )
        # Small star: those below a node, and the node, hang on the least of them.
        under, under_path = stored(large.groupBy("a").agg(F.min("b").alias("m")), "components-under")
        small = (
            large.join(under.hint("merge"), "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .unionByName(under.select("a", F.col("m").alias("b")))
            .distinct()
        )
        old = path
        edges, path = stored(small, "components")
        for spent in (old, least_path, large_path, under_path):
            remove(spark, spent)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
