"""Work lists: registered scripts of one kind that wait for translation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.schema import KEY, WORKLIST_KINDS
from scriptloom.sources.registry import read_registry


def worklist(registry: DataFrame, kind: str, limit: int | None = 0) -> DataFrame:
    """Key and body of the scripts of a kind; no limit, or one below 1, means all.

    Kinds are compared as stored, case included. The table list carries the load time.
    """
    object_type, operation_type = WORKLIST_KINDS[kind]
    load_time = ["_stg_sql_file_load_ts"] if kind == "table" else []
    rows = registry.where(
        (F.col("stmt_type") == "DDL")
        & (F.col("object_type") == object_type)
        & (F.col("operation_type") == operation_type)
    ).select(*KEY, *load_time, "sql_body")
    if limit and limit > 0:
        rows = rows.orderBy(*KEY).limit(limit)
    return rows


def stored_worklist(
    spark: SparkSession, root: str, kind: str, limit: int | None = 0, only_open: bool = False
) -> DataFrame:
    """Work list read from a stored registry; only the kind's folder is scanned.

    `only_open` leaves out scripts that have a translation, before the limit applies.
    """
    object_type, _ = WORKLIST_KINDS[kind]
    rows = read_registry(spark, root, "DDL", object_type, translations=only_open)
    if only_open:
        rows = rows.where(F.col("target_sql").isNull())
    return worklist(rows, kind, limit)
