"""Columns that are computed exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions later steps refer to but never repeat.

    The optimizer inlines a projected expression into every filter and projection
    above it. With costly text expressions that refer to each other the copies
    multiply. Unnesting a one-element array keeps them where they are.
    """
    values = F.struct(*[column.alias(name) for name, column in columns.items()])
    return rows.select("*", F.inline(F.array(values)))
