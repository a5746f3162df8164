"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows go from each stored partition to each shard is drawn first, exactly as a
uniform permutation would have it (a multivariate hypergeometric law, split down a binary
tree over the partitions). Each partition then permutes its own rows and deals them out by
its row of the matrix, and each shard permutes what it gets. Everything is built-in
columns; the random numbers are hashes of a seed and a position, so that a task that runs
again does the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import let, stored, uniform

#: Rows of a shard that are ordered together; larger shards are ordered in slices.
SLICE_ROWS = 65_536
#: From this level of the tree on its nodes are drawn in parallel.
PARALLEL_LEVEL = 6


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` draws out of `total` rows hit the `good` ones, by inversion of `u`.

    The weights of the law are summed over nine standard deviations and forty steps on
    either side of the mean, beyond which lies less than a double can tell from nothing.
    """
    t, g, n = (c.cast("double") for c in (total, good, draws))
    safe = F.greatest(t, F.lit(1.0))
    mean = n * g / safe
    spread = F.sqrt(F.greatest(mean * (1 - g / safe) * (t - n) / F.greatest(t - 1, F.lit(1.0)), F.lit(0.0))) * 9 + 40
    least = F.greatest(F.lit(0.0), n - (t - g))
    most = F.least(n, g)
    low = F.greatest(least, F.floor(mean - spread)).cast("long")
    high = F.least(most, F.ceil(mean + spread)).cast("long")

    def heavier(k: Column) -> Column:
        k = k.cast("double")
        return (g - k) * (n - k) / ((k + 1) * (t - g - n + k + 1))

    def draw(range_: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        total_weight = F.aggregate(
            range_,
            start,
            lambda a, k: F.struct((a["w"] * heavier(k)).alias("w"), (a["sum"] + a["w"]).alias("sum")),
            lambda a: a["sum"],
        )
        first = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), low.alias("at"))
        return let(
            total_weight * u,
            lambda goal: F.aggregate(
                range_,
                first,
                lambda a, k: F.struct(
                    (a["w"] * heavier(k)).alias("w"),
                    (a["sum"] + a["w"]).alias("sum"),
                    F.when((a["sum"] <= goal) & (a["w"] > 0), k).otherwise(a["at"]).alias("at"),
                ),
                lambda a: a["at"],
            ),
        )

    return let(F.sequence(low, high), draw)


def multivariate(caps: Column, draws: Column, *seed: Column) -> Column:
    """How `draws` draws without replacement fall on the shards, `caps` being their free places."""

    def step(acc: Column, shard: Column) -> Column:
        got = hypergeometric(acc["total"], shard["cap"], acc["draws"], uniform(*seed, shard["at"]))
        return let(
            got,
            lambda x: F.struct(
                (acc["total"] - shard["cap"]).alias("total"),
                (acc["draws"] - x).alias("draws"),
                F.concat(acc["out"], F.array(x)).alias("out"),
            ),
        )

    shards = F.transform(caps, lambda c, i: F.struct(c.alias("cap"), i.alias("at")))
    total = F.aggregate(caps, F.lit(0).cast("long"), lambda a, c: a + c)
    start = F.struct(total.alias("total"), draws.alias("draws"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(shards, start, step, lambda a: a["out"])


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, sent): how many rows partition `part` sends to each shard.

    `counts` has (part, n), one row per partition. The counts, eight bytes for each
    partition, sit in the root of the tree; below it both halves of a node are drawn apart.
    """
    spark = counts.sparkSession
    root = counts.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("part", "n"))).alias("leaves"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"),
    )
    share = F.floor(F.col("total") / shards).cast("long")
    caps = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: share + F.when(s < F.col("total") % shards, 1).otherwise(0).cast("long"),
    )
    nodes = root.select(F.lit(1).cast("long").alias("node"), "leaves", caps.alias("caps"))
    levels = max(0, (max(1, counts.count()) - 1).bit_length())
    for level in range(levels):
        half = F.ceil(F.size("leaves") / 2).cast("int")
        left = F.slice("leaves", F.lit(1), F.greatest(half, F.lit(1)))
        right = F.slice("leaves", half + 1, F.greatest(F.size("leaves") - half, F.lit(0)))
        size = F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        draw = multivariate(F.col("caps"), size, F.lit(seed), F.col("node"))
        nodes = nodes.withColumn("one", F.explode(F.array(draw))).select(
            F.inline(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), left.alias("leaves"), F.col("one").alias("caps")),
                    F.struct(
                        (F.col("node") * 2 + 1).alias("node"),
                        right.alias("leaves"),
                        F.zip_with("caps", "one", lambda c, x: c - x).alias("caps"),
                    ),
                )
            )
        ).where(F.size("leaves") > 0)
        if level == PARALLEL_LEVEL:
            nodes = nodes.repartition("node")
    return nodes.where(F.size("leaves") > 0).select(
        F.element_at("leaves", 1)["part"].alias("part"), F.col("caps").alias("sent")
    )


def shuffle_into_shards(rows: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """Adds `shard` (0 to shards - 1) and `slot` (from 0 without gaps) to the rows.

    Shard sizes differ by one row at most, and every assignment and order is equally
    likely. The rows are stored first, which fixes what a partition holds. Nulls,
    repeated rows and other columns play no part; an empty table stays empty. Columns named
    shard or slot are replaced; the others are carried through, so pass narrow rows.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    payload = rows.select(F.struct(*names).alias("payload"))
    kept, _ = stored(payload.withColumn("_row", F.monotonically_increasing_id()), "shuffle-rows")
    part = F.shiftright("_row", 33)
    counts, _ = stored(kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")), "shuffle-counts")
    total = counts.agg(F.sum("n").alias("t")).first()["t"] or 0
    matrix, _ = stored(communication_matrix(counts, shards, seed), "shuffle-matrix")

    # Permute inside each partition, then deal out by its row of the matrix.
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "_row"), "_row")
    dealt = (
        kept.withColumn("part", part)
        .withColumn("place", F.row_number().over(local))
        .join(matrix, "part")
        .withColumn(
            "shard",
            F.aggregate(
                "sent",
                F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("shard")),
                lambda a, x: F.struct(
                    (a["sum"] + x).alias("sum"),
                    (a["shard"] + F.when(a["sum"] + x < F.col("place"), 1).otherwise(0)).alias("shard"),
                ),
                lambda a: a["shard"],
            ),
        )
    )
    # Exchange, and permute inside each shard: by a random key, in slices of its range.
    bits = max(0, (max(1, total // (shards * SLICE_ROWS)) - 1).bit_length())
    key = F.xxhash64(F.lit(seed), F.lit("shard"), "_row")
    slice_ = F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")
    sent, _ = stored(
        dealt.select("payload", "_row", "shard", key.alias("key"), slice_.alias("slice")), "shuffle-sent"
    )
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        sent.groupBy("shard", "slice")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    # Keys compare unsigned inside a slice as they do between slices.
    inside = Window.partitionBy("shard", "slice").orderBy(F.col("key").bitwiseXOR(F.lit(-(2**63))), "_row")
    return (
        sent.withColumn("place", F.row_number().over(inside))
        .join(bases, ["shard", "slice"])
        .select("payload.*", "shard", (F.col("base") + F.col("place") - 1).cast("long").alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """Documents (doc_id, text) dealt into shards under the law `rows`.

    Returns doc_id, size (UTF-8 bytes and one; a null text has none), text_crc32 (of the
    empty text for null), law, shard, slot, grown_shard (null: the law keeps no key).
    """
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    return shuffle_into_shards(narrow, shards, seed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
