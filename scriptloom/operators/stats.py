"""Inventory counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions.text import title_case


def _scripts(n: str | None) -> Column:
    return F.count(F.lit(1)) if n is None else F.sum(n)


def object_type_stats(registry: DataFrame, n: str | None = None) -> DataFrame:
    """DDL scripts per object kind in title case, most frequent first.

    Counting the stored kinds first leaves the title casing to a handful of rows. `n` names
    a column of an inventory that counts scripts already.
    """
    per_kind = (
        registry.where(F.col("stmt_type") == "DDL")
        .groupBy("object_type")
        .agg(_scripts(n).alias("n"))
    )
    return (
        per_kind.groupBy(title_case(F.col("object_type")).alias("db_object_type"))
        .agg(F.sum("n").alias("object_count"))
        .orderBy(F.col("object_count").desc(), "db_object_type")
    )


def stmt_type_stats(registry: DataFrame, n: str | None = None) -> DataFrame:
    """Scripts per statement kind, most frequent first; `n` as in `object_type_stats`."""
    return (
        registry.groupBy(F.col("stmt_type").alias("operation_type"))
        .agg(_scripts(n).alias("operation_count"))
        .orderBy(F.col("operation_count").desc(), "operation_type")
    )
