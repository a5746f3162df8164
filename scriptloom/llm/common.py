"""Small helpers: stored intermediate tables, their removal, rows ranked at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.operators.skew import key_hash, salted_left_join
from scriptloom.session import work_dir

#: A key with at least this share of the counted rows is spread over salts, so at most
#: 1 / HOT_SHARE keys are ever listed.
HOT_SHARE = 0.001
#: Keys with fewer rows than this never need spreading.
HOT_ROWS = 256
SALTS = 32

#: Narrow rows (a few numbers each) that are sent to every task, at most: about 32 MB.
BROADCAST_ROWS = 1 << 20

#: Folders that lazily returned results still read; see `release`.
_OPEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, label: str) -> str:
    """A new folder all executors can reach, removed by `release`."""
    path = work_dir(spark, label)
    _OPEN.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _OPEN:
        _OPEN.remove(path)


def release(spark: SparkSession) -> None:
    """Removes the stored tables behind results that nobody reads any more."""
    for path in list(_OPEN):
        remove(spark, path)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more.

    It does so after a collection of the driver's heap, which may be long in coming.
    """
    spark._jvm.System.gc()


def sized(frame: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored, narrow frame to join with: sent whole to every task if it has few rows.

    With more rows the join shuffles both sides.
    """
    return F.broadcast(frame) if frame.count() <= most else frame.hint("merge")


def stored(frame: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The frame as a written table: short lineage, and lost executors cost no recomputation."""
    spark = frame.sparkSession
    path = folder(spark, label)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def hot_hashes(counts: DataFrame, keys: list[str], n: str = "n") -> list[int]:
    """Hashes of the keys that hold a thousandth of the counted rows or more.

    `counts` has one row per key. At most 1,000 keys can hold such a share, which bounds
    what reaches the driver. The list shapes the plan of a join, never its result.
    """
    total = counts.agg(F.sum(n).alias("t")).first()["t"] or 0
    least = max(HOT_ROWS, total * HOT_SHARE)
    return [r["h"] for r in counts.where(F.col(n) >= least).select(key_hash(keys).alias("h")).collect()]


def spread_left_join(
    rows: DataFrame, counts: DataFrame, keys: list[str], spread_by: list[str], n: str = "n"
) -> DataFrame:
    """Left join of many rows with one row per key; rows of hot keys go to several tasks.

    Always a shuffled join, so that its cost grows evenly with the rows.
    """
    hot = hot_hashes(counts, keys, n)
    counts = counts.hint("merge")
    return salted_left_join(rows, counts, keys, hot, spread_by, SALTS)


def uniform(*parts: Column | int | str) -> Column:
    """A number in [0, 1) that depends on the given values only."""
    bits = F.shiftrightunsigned(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ranked(frame: DataFrame, group: list[str], order: list[Column], label: str) -> tuple[DataFrame, DataFrame]:
    """Rows in order, dealt out by ranges, and where each range starts in its group.

    Returns the stored rows with `part` and `place` (from 1, within group and part) and a
    table (group..., part, n, base): the rank of a row in its group is base + place. No
    group meets in one task, however large; the second table has at most one row for each
    group and one more for each range.
    """
    keys = [F.col(c) for c in group]
    parts, _ = stored(
        frame.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()), label
    )
    counts = parts.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"))
    before = _window(group).orderBy("part").rowsBetween(-(2**63), -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
    rows = parts.withColumn("place", F.row_number().over(_window([*group, "part"]).orderBy(*order)))
    return rows, bases


def _window(columns: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)
