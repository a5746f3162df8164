"""Embedding near-dedup by a subspace pigeonhole join.

Two unit vectors with cosine c are sqrt(2 - 2c) apart. A seeded rotation spreads that over
all coordinates; cut into blocks, at least one block must hold no more than its share of the
squared distance, in proportion to its width. So vectors are range-joined in every block: a
grid over the block's first coordinates, in cells of twice the block's radius, brings
together what can be that close, each vector also as a guest in the cells its radius
reaches. Pairs that pass in a block are verified there with the whole vectors in double
precision, and counted in the first block they pass in, so no pair is counted twice and none
is ever shuffled. Cells with many vectors are cut into tiles, of which each pair is a task of
its own; only counts and a spanning forest of the links leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import stored
from scriptloom.llm.components import components

COSINE = 0.93
#: Coordinates of a block, and how many of them the grid uses.
BLOCK = 16
GRID = 2
#: Vectors of a tile, and those compared at a time.
TILE = 2048
STEP = 512
SEED = 42


def rotation(width: int, seed: int = SEED) -> np.ndarray:
    """An orthogonal matrix, the same for each seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def block_edges(width: int, block: int = BLOCK) -> list[tuple[int, int]]:
    return [(a, min(a + block, width)) for a in range(0, width, block)]


def block_budgets(width: int, cosine: float, block: int = BLOCK) -> list[float]:
    """Each block's share of the squared distance, with a little slack for rounding."""
    return [(2 - 2 * cosine) * (b - a) / width * (1 + 1e-6) + 1e-9 for a, b in block_edges(width, block)]


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def _cells(turned: np.ndarray, radius: float, grid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, cell, home) for the cells that each vector's ball can reach.

    A cell is numbered by its coordinates, 16 bits each.
    """
    side = 2 * radius
    low, home = np.floor((turned - radius) / side), np.floor(turned / side)
    high = np.floor((turned + radius) / side)
    owner, cell = np.arange(len(turned)), np.zeros(len(turned), np.int64)
    at_home = np.ones(len(turned), bool)
    for g in range(grid):
        parts = []
        for k in range(2):  # a ball of half a side reaches two cells in each direction
            to = low[owner, g] + k
            fits = to <= high[owner, g]
            number = (to.astype(np.int64) & 0xFFFF) + (cell << 16)
            parts.append((owner[fits], number[fits], (at_home & (to == home[owner, g]))[fits]))
        owner, cell, at_home = (np.concatenate(x) for x in zip(*parts))
    return owner, cell, at_home


def _placed(vectors: DataFrame, cosine: float, block: int, grid: int, kind: str) -> DataFrame:
    """(node, label, width, block, cell, home, vector) for every cell a vector stands in."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                raw = batch.column("vector").to_pylist()
                sizes = np.array([len(v) for v in raw]) // np.dtype(kind).itemsize
                for width in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == width)
                    x = _unit(np.stack([np.frombuffer(raw[i], kind) for i in rows]).astype("<f8")) @ rotation(width)
                    for number, ((a, b), budget) in enumerate(zip(block_edges(width, block), block_budgets(width, cosine, block))):
                        g = min(grid, b - a)
                        owner, cell, home = _cells(x[:, a : a + g], budget**0.5, g)
                        at = rows[owner]
                        n = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("node").take(pa.array(at)),
                                batch.column("label").take(pa.array(at)),
                                pa.array(np.full(n, width, np.int32)),
                                pa.array(np.full(n, number, np.int32)),
                                pa.array(cell),
                                pa.array(home),
                                batch.column("vector").take(pa.array(at)),
                                batch.column("times").take(pa.array(at)),
                            ],
                            ["node", "label", "width", "block", "cell", "home", "vector", "times"],
                        )

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(
        place, f"node long, label {label}, width int, block int, cell long, home boolean, vector binary, times long"
    )


def _tiles(placed: DataFrame, tile: int) -> DataFrame:
    """Rows with `i` and `j`: the pairs of tiles of its cell that a row takes part in.

    Tile i holds vectors at home, tile j any of the cell. Tiles are dealt by a hash of the node.
    """
    cell = ["label", "width", "block", "cell"]
    sizes = placed.groupBy(*cell).agg(
        F.ceil(F.count(F.when(F.col("home"), 1)) / tile).cast("int").alias("hosts"),
        F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("all"),
    )
    sizes, _ = stored(sizes, "near-cells")
    at = F.xxhash64(F.lit(SEED), "node")
    # Cells without a home vector hold no pair that is not found elsewhere.
    sized = placed.join(sizes.where("hosts > 0"), cell)
    as_host = F.transform(
        F.sequence(F.lit(0), F.col("all") - 1),
        lambda j: F.struct(F.pmod(at, F.col("hosts")).cast("int").alias("i"), j.alias("j"), F.lit(True).alias("host")),
    )
    as_any = F.transform(
        F.sequence(F.lit(0), F.col("hosts") - 1),
        lambda i: F.struct(i.alias("i"), F.pmod(at, F.col("all")).cast("int").alias("j"), F.lit(False).alias("host")),
    )
    both = F.concat(F.when(F.col("home"), as_host).otherwise(F.slice(as_host, 1, 0)), as_any)
    return sized.withColumn("_t", F.explode(both)).select(*cell, "_t.*", "node", "vector", "times")


def _compare(tiles: DataFrame, cosine: float, block: int, kind: str) -> DataFrame:
    """(a, b, n): partial link counts (b null) and links of a spanning forest (n null)."""

    def compare(table: pa.Table) -> pa.Table:
        width, number = table.column("width")[0].as_py(), table.column("block")[0].as_py()
        host = table.column("host").to_numpy()
        node, times = table.column("node").to_numpy(), table.column("times").to_numpy()
        raw = table.column("vector").to_pylist()
        x = np.frombuffer(b"".join(raw), kind).astype("<f8").reshape(len(raw), width)
        del raw
        norm = np.linalg.norm(x, axis=1)
        turned = (x / norm[:, None]) @ rotation(width)
        edges, budgets = block_edges(width, block), block_budgets(width, cosine, block)
        mine, other = np.flatnonzero(host), np.flatnonzero(~host)
        a, b = edges[number]
        counts = np.zeros(len(mine), np.int64)
        _, place = np.unique(node, return_inverse=True)
        root, links = np.arange(len(node)), []
        lengths = (turned[:, a:b] ** 2).sum(1)
        for low in range(0, len(mine), STEP):
            u = mine[low : low + STEP]
            near = lengths[u][:, None] + lengths[other][None, :] - 2 * turned[u, a:b] @ turned[other, a:b].T
            p, q = np.nonzero(near <= budgets[number])
            keep = node[u[p]] != node[other[q]]
            p, q = p[keep], q[keep]
            for start in range(0, len(p), 65536):
                s = slice(start, start + 65536)
                uu, vv = u[p[s]], other[q[s]]
                first = np.ones(len(uu), bool)
                for earlier in range(number):  # counted in the first block it passes in
                    c, d = edges[earlier]
                    lu, lv = (turned[uu, c:d] ** 2).sum(1), (turned[vv, c:d] ** 2).sum(1)
                    gap = lu + lv - 2 * np.einsum("ij,ij->i", turned[uu, c:d], turned[vv, c:d])
                    first &= gap > budgets[earlier]
                uu, vv, at = uu[first], vv[first], p[s][first]
                linked = np.einsum("ij,ij->i", x[uu], x[vv]) / (norm[uu] * norm[vv]) >= cosine
                uu, vv, at = uu[linked], vv[linked], at[linked]
                np.add.at(counts, low + at, times[vv])
                root = _span(root, uu, vv, place, node, links)
        some = np.flatnonzero(counts)
        one = np.concatenate([node[mine[some]], np.array([l[0] for l in links], np.int64)])
        two = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array([l[1] for l in links], pa.int64())])
        n = pa.concat_arrays([pa.array(counts[some]), pa.nulls(len(links), pa.int64())])
        return pa.Table.from_arrays([pa.array(one), two, n], ["a", "b", "n"])

    keys = ["label", "width", "block", "cell", "i", "j"]
    return tiles.groupBy(*keys).applyInArrow(compare, "a long, b long, n long")


def _span(root: np.ndarray, uu, vv, place, node, links: list) -> np.ndarray:
    """Adds to `links` those pairs that join components, a few for each left end at a time."""
    while True:
        apart = root[place[uu]] != root[place[vv]]
        if not apart.any():
            return root
        uu, vv = uu[apart], vv[apart]
        _, first = np.unique(place[uu], return_index=True)
        for u, v in zip(uu[first].tolist(), vv[first].tolist()):
            a, b = place[u], place[v]
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((int(node[u]), int(node[v])))
        while (up := root[root] != root).any():
            root = np.where(up, root[root], root)


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, grid: int = GRID, tile: int = TILE
) -> DataFrame:
    """One row per vector (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors of the same, non-null label and the same length can link. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing; so do those
    without a label. Equal vectors are compared once and count each. Of rows that repeat a
    vec_id in one component, each is kept if the component's id is theirs. Other columns are
    not read; an empty table gives an empty result.
    """
    good = (
        F.col("label").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0)
    )
    # Floats travel as floats: they are the same numbers in double precision.
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    rows = vectors.select(
        "vec_id", "label", F.when(F.coalesce(good, F.lit(False)), F.col("embedding").cast("array<double>")).alias("x")
    )
    rows, _ = stored(rows.withColumn("row", F.monotonically_increasing_id()), "near-rows")
    # Equal vectors of a label are one node, named by its least row.
    equal = rows.where("x is not null").withColumn("x", F.transform("x", lambda v: v + 0.0))
    nodes, _ = stored(
        equal.groupBy("label", "x").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("times")), "near-nodes"
    )
    owners, _ = stored(equal.join(nodes.hint("merge"), ["label", "x"]).select("row", "node", "times"), "near-owners")
    packed = nodes.mapInArrow(_pack(kind), f"node long, label {rows.schema['label'].dataType.simpleString()}, vector binary, times long")
    placed, _ = stored(_placed(packed, cosine, block, grid, kind), "near-placed")
    found, _ = stored(_compare(_tiles(placed, tile), cosine, block, kind), "near-found")
    counts = found.where("b is null").groupBy(F.col("a").alias("_c")).agg(F.sum("n").alias("n"))
    classes = components(found.where("b is not null").select("a", "b"))
    own = (
        rows.select("vec_id", "row")
        .join(owners, "row", "left")
        .join(counts, F.col("node") == F.col("_c"), "left")
        .drop("_c")
        .join(classes.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
        .select(
            "vec_id",
            (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("times") - 1, F.lit(0))).cast("long").alias("n_links"),
            F.coalesce("root", "node", "row").alias("class"),
        )
    )
    own, _ = stored(own, "near-own")
    least, _ = stored(own.groupBy("class").agg(F.min("vec_id").alias("component_id")), "near-least")
    return own.join(least.hint("merge"), "class").select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _pack(kind: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            blobs = [flat[a:b].astype(kind).tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("label"), pa.array(blobs, pa.binary()), batch.column("times")],
                ["node", "label", "vector", "times"],
            )

    return pack
