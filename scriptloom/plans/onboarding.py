"""From a stage folder to classified rows in the registry."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions.prompts import build_prompt
from scriptloom.operators.classify import (
    classification_rejects,
    classify_scripts,
    parse_classification,
    usable,
)
from scriptloom.operators.complete import BackendFactory, complete
from scriptloom.operators.ingest import failed_rows, new_scripts, registry_rows
from scriptloom.schema import SCRIPT_PATTERN
from scriptloom.session import remove_dir, work_dir
from scriptloom.sources.commits import head
from scriptloom.sources.manifest import changed_files, record_files
from scriptloom.sources.registry import read_registry, registry_insert
from scriptloom.sources.stage import list_scripts, read_scripts, with_file_name


@dataclass(frozen=True)
class Onboarded:
    version: int
    rejects: DataFrame
    #: The rejects in registry layout, their status columns telling why they failed.
    failed: DataFrame


def onboard(
    spark: SparkSession,
    roots: str | Sequence[str],
    registry: str,
    limit: int | None = None,
    pattern: str = SCRIPT_PATTERN,
    backend: BackendFactory | None = None,
    ledger: str | None = None,
    opened: Accumulator | None = None,
) -> Onboarded:
    """Classify the scripts that are not registered yet and insert the usable ones.

    The stage is listed in tasks; only files that are new or changed since the registry took
    them in are opened, each once. `opened` counts them.

    Repeated and registered scripts are left out before the classification. Scripts
    with equal keys have equal bodies, hence equal replies, so this cannot hide a
    usable copy behind an unusable one. Without a backend the rules classify.
    """
    changed = changed_files(list_scripts(spark, roots, pattern), registry)
    changed_path, scanned_path = work_dir(spark, "changed"), work_dir(spark, "scanned")
    changed.write.parquet(changed_path)
    read_scripts(spark.read.parquet(changed_path), opened).write.parquet(scanned_path)
    scanned = spark.read.parquet(scanned_path)
    scripts = with_file_name(scanned.drop("modified_ms", "length"))
    since = head(spark, registry)
    fresh = new_scripts(scripts, read_registry(spark, registry, translations=False))
    if limit is not None:
        # Cut what is new, not what is there: repeated runs come to every file.
        fresh = fresh.orderBy("path").limit(limit)
    # What is new is found once, also when a service is asked and answers are joined back.
    fresh_path = work_dir(spark, "fresh")
    fresh.write.parquet(fresh_path)
    fresh = spark.read.parquet(fresh_path)
    if backend is None:
        replied = classify_scripts(fresh)
    else:
        asked = fresh.withColumn("prompt", build_prompt("classify", F.col("sql_body")))
        replied = complete(asked, backend, ledger, spread_by=["path"]).drop("prompt")
    # Both outcomes are read from one table: the scan and its shuffle run once.
    staged = work_dir(spark, "classified")
    parse_classification(replied).write.parquet(staged)
    parsed = spark.read.parquet(staged)
    version = registry_insert(registry_rows(usable(parsed)), registry, since)
    record_files(scanned, registry)
    for spent in (fresh_path, scanned_path, changed_path):
        remove_dir(spark, spent)
    return Onboarded(version, classification_rejects(parsed), failed_rows(parsed))
