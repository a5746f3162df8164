"""Translating what the registry holds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.operators.complete import BackendFactory
from scriptloom.operators.tasks import SERVICE_ONLY, answer_task
from scriptloom.operators.translate import TRANSLATORS, translate_registry
from scriptloom.operators.worklist import stored_worklist
from scriptloom.schema import COMPAT_TARGET_KINDS, KEY, TARGET_KINDS, WORKLIST_KINDS
from scriptloom.sources.commits import ConflictError, head
from scriptloom.sources.registry import (
    add_translations,
    drop_versions,
    has_translations,
    read_registry,
    write_snapshot,
)

#: Times that a snapshot is made again because others have committed meanwhile.
ATTEMPTS = 5


def migrate_all(
    spark: SparkSession,
    registry: str,
    kinds: list[str] | None = None,
    compat: bool = False,
    batch_ts: datetime | None = None,
    overwrite: bool = False,
    keep_versions: int | None = None,
) -> int:
    """Translate every script of the kinds by rules and write the next version.

    Scripts that are translated, by whatever means, stay as they are unless `overwrite` is
    set. One pass from files to files, with a shuffle only to take in translations that were
    recorded since the last version. When others add to the registry meanwhile it starts
    again from what is there then. `keep_versions` deletes all but the newest.
    """
    for attempt in range(ATTEMPTS):
        since = head(spark, registry)
        joined = has_translations(spark, registry)
        rows = translate_registry(read_registry(spark, registry), kinds, compat, batch_ts, overwrite)
        try:
            version = write_snapshot(rows, registry, rebalance=joined, since=since)
            break
        except ConflictError:
            if attempt + 1 == ATTEMPTS:
                raise
    if keep_versions:
        drop_versions(spark, registry, keep_versions)
    return version


def migrate_worklist(
    spark: SparkSession,
    registry: str,
    kind: str,
    limit: int | None = 0,
    compat: bool = False,
    batch_ts: datetime | None = None,
    backend: BackendFactory | None = None,
    ledger: str | None = None,
    again: bool = False,
) -> int:
    """Translate one work list, by rules or by a backend, and record the result.

    The list holds scripts without a translation, so repeated runs with a limit go on where
    the last one ended; `again` takes the first ones whether translated or not. A script
    the backend failed on keeps what it had. Returns the version added to.
    """
    if kind not in WORKLIST_KINDS:
        raise ValueError(f"unknown kind: {kind}")
    work = stored_worklist(spark, registry, kind, limit, only_open=not again)
    if backend is None:
        updates = TRANSLATORS[kind](work, compat)
    else:
        updates = completed_translation(work, kind, backend, ledger, compat)
    return add_translations(updates, registry, batch_ts)


# What a run adds to the translations of a kind.
FOLLOW_UPS = {"table": ["copy"], "view": ["view_dependency", "view_summary"], "trigger": ["trigger_summary"]}


def follow_up(
    spark: SparkSession,
    registry: str,
    kind: str,
    backend: BackendFactory | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """Key, `task`, `response` and `error` of the further outputs of a kind.

    Load statements come from the translated tables; dependencies and summaries from the
    views and triggers themselves. Without a backend the tasks only a service can answer
    are left out.
    """
    if kind not in FOLLOW_UPS:
        raise ValueError(f"nothing follows the translation of: {kind}")
    object_type, operation_type = WORKLIST_KINDS[kind]
    rows = read_registry(spark, registry, "DDL", object_type).where(F.col("operation_type") == operation_type)
    found = None
    for task in FOLLOW_UPS[kind]:
        if backend is None and task in SERVICE_ONLY:
            continue
        scripts = rows.select(*KEY, "sql_body")
        if task == "copy":
            scripts = rows.where(F.col("target_sql").isNotNull()).select(*KEY, F.col("target_sql").alias("sql_body"))
        part = answer_task(scripts, task, backend, ledger).select(*KEY, F.lit(task).alias("task"), "response", "error")
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError(f"{kind} needs a completion backend")
    return found


def completed_translation(
    work: DataFrame,
    kind: str,
    backend: BackendFactory,
    ledger: str | None = None,
    compat: bool = False,
) -> DataFrame:
    """Translations of a work list by a completion backend, failures left out."""
    target_kind = (COMPAT_TARGET_KINDS if compat else TARGET_KINDS)[kind]
    return (
        answer_task(work, kind, backend, ledger)
        .where(F.col("error").isNull())
        .select(
            *KEY,
            F.col("response").alias("target_sql"),
            F.lit(target_kind).cast("string").alias("target_object_type"),
        )
    )
