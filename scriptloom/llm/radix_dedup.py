"""Exact dedup by distributed MSD radix partitioning.

Documents are split by their leading bytes, the groups that still have several members by
the bytes after those, and so on, until a group has one member or its texts have ended.
What ends together is equal byte by byte: no digest decides. The digits widen from round
to round, so that most documents leave after a few bytes and long copies need few rounds.

Counts are pre-aggregated before the shuffle, so a group of copies costs one row per task;
the join back spreads large groups over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import folder, remove, spread_left_join, stored

#: Bytes of the first digit, growth from round to round, and the widest digit.
FIRST_DIGIT = 32
GROWTH = 16
WIDEST = 1 << 20


def normalised(text: Column) -> Column:
    """The text without the characters `[\\x20\\x09-\\x0D]`; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def radix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after `normalised`. The row with the most code points in
    its original text stays, then the smallest id; a null id loses to any other. Null and
    blank texts form one group. Of rows that repeat id and text one stays. Other columns,
    whatever their names, are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    norm = narrow.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"), normalised(F.col("text")).alias("norm"))
    state = norm.select(
        F.lit(0).cast("long").alias("gid"),
        "doc_id",
        "n_chars",
        F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.col("norm").cast("binary").alias("tail"),
    )
    finished: list[DataFrame] = []
    previous: str | None = None
    width = FIRST_DIGIT
    while True:
        done, state_next, path = _round(state, width, len(finished))
        finished.append(done)
        if previous:
            remove(spark, f"{previous}/done=false")
        if state_next.isEmpty():
            break
        state, previous, width = state_next, path, min(width * GROWTH, WIDEST)
    rows = finished[0]
    for more in finished[1:]:
        rows = rows.unionByName(more)
    return _one_of_repeats(rows).select(
        "doc_id",
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("n_chars").alias("n_original"),
    )


def _round(state: DataFrame, width: int, number: int) -> tuple[DataFrame, DataFrame, str]:
    """Splits every open group by one digit; returns what is decided and what goes on."""
    spark = state.sparkSession
    digit = F.substring("tail", 1, width)
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id")))
    groups, groups_path = stored(
        state.groupBy("gid", digit.alias("digit"))
        .agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
        .where("n > 1")
        .select(
            "gid",
            "digit",
            "n",
            F.col("best.id").alias("keep"),
            (-F.col("best.c")).alias("keep_chars"),
            F.monotonically_increasing_id().alias("next"),
        ),
        "radix-groups",
    )
    split = spread_left_join(state.withColumn("digit", digit), groups, ["gid", "digit"], ["doc_id", "n_chars"])
    alone, ended = F.col("n").isNull(), F.octet_length("digit") < width
    done = alone | ended
    path = folder(spark, "radix-round")
    (
        split.select(
            "doc_id",
            "n_chars",
            "sha",
            F.when(alone, F.col("doc_id")).when(ended, F.col("keep")).alias("keep_id"),
            F.when(alone, F.col("n_chars")).when(ended, F.col("keep_chars")).alias("keep_chars"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.when(~done, F.col("next")).alias("gid"),
            F.when(~done, F.substring(F.col("tail"), width + 1, 2**31 - 1)).alias("tail"),
            F.monotonically_increasing_id().alias("row"),
            done.alias("done"),
        )
        .write.partitionBy("done")
        .option("compression", "zstd")
        .parquet(path)
    )
    remove(spark, groups_path)
    kind = dict(state.dtypes)["doc_id"]
    both = spark.read.schema(
        f"doc_id {kind}, n_chars int, sha binary, keep_id {kind}, keep_chars int, group_size long, "
        "gid long, tail binary, row long, done boolean"
    ).parquet(path)
    return (
        both.where("done").drop("gid", "tail", "done").withColumn("round", F.lit(number)),
        both.where("not done").select("gid", "doc_id", "n_chars", "sha", "tail"),
        path,
    )


def _one_of_repeats(rows: DataFrame) -> DataFrame:
    """Adds `kept`; of rows that repeat the id and the text of the one that stays, one is."""
    rows = rows.withColumn("place", F.struct("round", "row"))
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    repeated = (
        rows.where(best)
        .groupBy(F.col("keep_id").alias("k"), F.col("sha").alias("s"))
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times"))
        .where("times > 1")
    )
    kept = (
        rows.where(best)
        .join(repeated, F.col("keep_id").eqNullSafe(F.col("k")) & (F.col("sha") == F.col("s")), "left")
        .withColumn("kept", F.col("times").isNull() | (F.col("place") == F.col("first")))
    )
    columns = ["doc_id", "keep_id", "group_size", "kept", "sha", "n_chars"]
    return kept.select(columns).unionByName(rows.where(~best).withColumn("kept", F.lit(False)).select(columns))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names.

    A document is told from others of its id by its text's digest and length; of rows that
    agree in all three one stays.
    """
    verdict = radix_dedup(docs)
    kept = verdict.where("kept").select(
        F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"), F.col("n_original").alias("_kept_n")
    )
    # The input goes along as one column, so that no name of it clashes.
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col("doc_id").alias("_id"),
        F.sha2(normalised(F.col("text")), 256).alias("_sha"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("_n"),
    )
    same = F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_sha") == F.col("_kept_sha")) & (F.col("_n") == F.col("_kept_n"))
    left = own.join(kept, same, "left_semi")
    if not verdict.where("not kept and doc_id <=> keep_id").limit(1).isEmpty():
        left = left.dropDuplicates(["_id", "_sha", "_n"])
    return left.select("_doc.*")
