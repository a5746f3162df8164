"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Most keys that are ever treated as hot. Any key outside the list holds less than
# about 1/HOT_KEYS of the rows.
HOT_KEYS = 256
HOT_ROWS = 1_000_000
SALTS = 64

_SALT = "__salt"


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def hot_key_hashes(
    rows: DataFrame, keys: list[str], min_rows: int = HOT_ROWS, most: int = HOT_KEYS
) -> list[int]:
    """Hashes of the most frequent keys with at least `min_rows` rows.

    One pass over the key columns with a frequent-items sketch per task: nothing is
    shuffled by key, and at most `most` numbers reach the driver. A miss only costs
    balance; results do not depend on this list.
    """
    sketch = F.expr(f"approx_top_k(h, {most}, {max(10 * most, 1000)})")
    top = rows.select(key_hash(keys).alias("h")).agg(sketch.alias("top")).first()
    return [e["item"] for e in (top["top"] or []) if e["count"] >= min_rows]


def salted_left_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    hot: list[int],
    spread_by: list[str],
    salts: int = SALTS,
) -> DataFrame:
    """Left join on `keys`, where `right` has one row per key.

    Left rows of a hot key are spread over `salts` partitions and the matching right
    row is copied to each, at most `len(hot) * salts` extra rows in all. The salt is
    a hash of `spread_by`, columns that tell the rows of one key apart: a task that
    runs again after a lost executor gives every row the same salt as before.
    """
    if not hot:
        return left.join(right, keys, "left")
    is_hot = key_hash(keys).isin(hot)
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    left = left.withColumn(_SALT, F.when(is_hot, spread).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn(_SALT, F.explode(copies))
    return left.join(right, [*keys, _SALT], "left").drop(_SALT)
