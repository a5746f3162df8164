"""Insert-if-absent and keyed update of registry rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.operators.skew import hot_key_hashes, salted_left_join
from scriptloom.schema import (
    AUDIT_ERR_MSG,
    AUDIT_STATUS,
    AUDIT_WORKED,
    CLASS_KEYS,
    FAILED_STATUS,
    FAILED_WORKED,
    KEY,
    REGISTRY_COLUMNS,
)


# Columns as long as a script: aggregated apart, so that a query which does not use
# them does not carry them through the shuffle either.
_LONG = ["sql_body", "response"]


def first_per_key(scripts: DataFrame, determined: Sequence[str] = ()) -> DataFrame:
    """One script per file name and content hash: the first by path.

    An aggregate rather than a ranking window: copies collapse in the map tasks, so a
    key that a third of all rows share sends one row per task through the shuffle.
    `determined` names columns that follow from the content, such as a classification
    by rules. Grouping by them too changes no group and lets a later filter on them run
    before the shuffle.
    """
    keys = ["sql_file_name", "md5", *determined]
    long = [c for c in scripts.columns if c in _LONG]
    short = [c for c in scripts.columns if c not in (*keys, "path", *long)]
    return (
        scripts.groupBy(*keys)
        .agg(
            F.min(F.struct("path", *short)).alias("first"),
            *[F.min_by(c, "path").alias(c) for c in long],
        )
        .select(*keys, "first.*", *long)
        .select(*scripts.columns)
    )


def _exact(column: str) -> Column:
    """The text of a column as a join key: never null, and no two texts alike."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def new_scripts(scripts: DataFrame, registry: DataFrame) -> DataFrame:
    """Scripts whose key is not registered yet, one per key.

    What is new is found from keys and paths alone. Bodies move only for the scripts that
    are, and once: the join that picks them and the removal of paths that were listed twice
    share one partitioning. A run that finds little new shuffles little, whatever the stage
    holds.
    """
    known = registry.select(
        F.col("sql_file_name"), F.col("_stg_sql_file_md5").alias("md5")
    ).distinct()
    keys = ["sql_file_name", "md5"]
    exact = {f"__{c}": _exact(c) for c in (*keys, "path")}
    first = scripts.groupBy(*keys).agg(F.min("path").alias("path")).join(known, keys, "left_anti")
    first = first.select(*[column.alias(name) for name, column in exact.items()])
    winners = scripts.withColumns(exact).join(first, list(exact), "left_semi")
    return winners.dropDuplicates(list(exact)).drop(*exact)


def registry_rows(
    classified: DataFrame,
    worked: Column | None = None,
    status: Column | None = None,
    message: Column | None = None,
) -> DataFrame:
    """Classified scripts in registry layout, with the audit constants of a success or others."""
    worked = F.lit(AUDIT_WORKED) if worked is None else worked
    status = F.lit(AUDIT_STATUS) if status is None else status
    message = F.lit(AUDIT_ERR_MSG) if message is None else message
    return classified.select(
        "sql_file_name",
        "sql_body",
        F.col("path").alias("_stg_sql_file_name"),
        F.col("load_ts").alias("_stg_sql_file_load_ts"),
        F.col("md5").alias("_stg_sql_file_md5"),
        worked.alias("completion_worked"),
        status.alias("completion_status"),
        message.alias("completion_err_msg"),
        F.col("response").alias("completion_response"),
        *CLASS_KEYS,
        F.lit(None).cast("string").alias("target_sql"),
        F.lit(None).cast("string").alias("target_object_type"),
        F.lit(None).cast("timestamp").alias("updated_ts"),
        F.lit(None).cast("boolean").alias("needs_review"),
    )


def failed_rows(parsed: DataFrame) -> DataFrame:
    """Scripts whose classification failed, in registry layout: the status columns tell why.

    They are for a log of their own. In the registry they would count as known and never
    be classified again.
    """
    failed = parsed.where(F.col("fault").isNotNull())
    return registry_rows(failed, F.lit(FAILED_WORKED), F.lit(FAILED_STATUS), F.col("fault"))


def apply_translation(
    registry: DataFrame,
    updates: DataFrame,
    batch_ts: datetime | None = None,
    order_by: str | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """The registry with target SQL, kind, time and review mark set where both keys match.

    All registry rows of a key change. `updates` has the key columns, `target_sql`,
    `target_object_type` and perhaps `updated_ts` and `needs_review`; the last one of a key
    by that time and by `order_by` wins, then the greatest text. An update without a text
    changes nothing. Inserts keep keys unique; for a registry where a key may repeat very
    often `hot_rows` spreads such keys, at the price of a pass over its key columns.
    """
    updates = updates.where(F.col("target_sql").isNotNull())
    stamp = F.current_timestamp() if batch_ts is None else F.lit(batch_ts)
    if "updated_ts" in updates.columns:
        stamp = F.col("updated_ts")
    last = F.max(
        F.struct(
            stamp.alias("new_ts"),
            *([order_by] if order_by else []),
            F.col("target_sql").alias("new_sql"),
            F.col("target_object_type").alias("new_type"),
            (F.col("needs_review") if "needs_review" in updates.columns else F.lit(None).cast("boolean")).alias("new_review"),
        )
    )
    latest = (
        updates.groupBy(*KEY)
        .agg(last.alias("last"))
        .select(*KEY, "last.new_sql", "last.new_type", "last.new_ts", "last.new_review")
    )
    hot = [] if hot_rows is None else hot_key_hashes(registry, KEY, hot_rows)
    joined = salted_left_join(registry, latest, KEY, hot, ["_stg_sql_file_name"])
    matched = F.col("new_ts").isNotNull()
    changed = {
        "target_sql": "new_sql",
        "target_object_type": "new_type",
        "updated_ts": "new_ts",
        "needs_review": "new_review",
    }
    return joined.select(
        *[
            F.when(matched, F.col(changed[c])).otherwise(F.col(c)).alias(c)
            if c in changed
            else F.col(c)
            for c in REGISTRY_COLUMNS
        ]
    )
