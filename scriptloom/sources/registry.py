"""The registry of scripts as versioned parquet snapshots.

Layout: `<root>/v=<n>/c=<commit>/part_stmt=<kind>/part_object=<kind>/*.parquet`. The partition
values are a bounded set derived from the stored columns, which keep exactly what
the classification said: a service that answers with free text cannot multiply
folders, and an empty or oddly cased kind survives the round trip.

An insert adds a folder to the latest version. Translations of a few scripts are added to
`<root>/translations/v=<n>/c=<commit>` and joined to the rows when they are read: updating 25
scripts does not rewrite the rest. A snapshot takes them in and becomes the next version.

Every change is a folder of its own that counts once the commit log names it, so readers see
whole commits only and what a failed writer left is never read. Beside the rows of a commit
lie their counts by kind, `<root>/counts/v=<n>/c=<commit>`: the inventory is their sum. Writers may work at once: one
that finds its place in the log taken looks at what the others have added. An insert then
leaves out what is registered by now, translations go to the version in force, and a
snapshot, which may lack rows, gives up with a `ConflictError` for its caller to start again.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.operators.ingest import apply_translation
from scriptloom.schema import KEY, REGISTRY_COLUMNS, REGISTRY_SCHEMA
from scriptloom.sources.commits import (
    INSERT,
    SNAPSHOT,
    TRANSLATIONS,
    Commit,
    ConflictError,
    commits,
    commits_of,
    head,
    put,
)

PARTITIONS = ["part_stmt", "part_object"]

_TRANSLATION_SCHEMA = (
    "sql_file_name string, _stg_sql_file_md5 string, target_sql string, "
    "target_object_type string, updated_ts timestamp, needs_review boolean"
)

# Scripts compress well, and a task reads at least one row group: bound a file by the
# text work it stands for, not by its bytes alone.
ROWS_PER_FILE = 50_000

# Kinds that get a folder of their own.
_STMT_FOLDERS = ["DDL", "DML", "DCL"]
_OBJECT_FOLDERS = ["table", "view", "function", "trigger"]


def _folder(value: Column, known: list[str]) -> Column:
    return F.when(value.isin(known), value).otherwise("other")


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY_SCHEMA)


def _file_system(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, root: str) -> bool:
    path, fs = _file_system(spark, root)
    return fs.exists(path)


def latest_version(spark: SparkSession, root: str) -> int | None:
    """The version in force, None when nothing was committed yet."""
    found = commits_of(spark, root)
    return found[-1].version if found else None


def _read_rows(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    """Rows of folders of one version, with their partition columns."""
    stored = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in REGISTRY_SCHEMA.fields)
    schema = f"{stored}, c string, part_stmt string, part_object string"
    base = f"{root}/{folders[0].rpartition('/')[0]}"
    reader = spark.read.schema(schema).option("basePath", base)
    return reader.parquet(*[f"{root}/{folder}" for folder in folders])


def read_registry(
    spark: SparkSession,
    root: str,
    stmt_type: str | None = None,
    object_type: str | None = None,
    version: int | None = None,
    translations: bool = True,
) -> DataFrame:
    """Registry rows in column order; the kinds given prune whole folders.

    Readers that use no target columns save the join by leaving the translations out.
    """
    found = commits_of(spark, root, version)
    folders = [c.folder for c in found if c.kind != TRANSLATIONS]
    if not folders:
        return empty_registry(spark)
    rows = _read_rows(spark, root, folders)
    if stmt_type is not None:
        rows = rows.where(
            (F.col("part_stmt") == _folder(F.lit(stmt_type), _STMT_FOLDERS))
            & (F.col("stmt_type") == stmt_type)
        )
    if object_type is not None:
        rows = rows.where(
            (F.col("part_object") == _folder(F.lit(object_type), _OBJECT_FOLDERS))
            & (F.col("object_type") == object_type)
        )
    rows = rows.select(*REGISTRY_COLUMNS)
    added = [f"{root}/{c.folder}" for c in found if c.kind == TRANSLATIONS]
    if not translations or not added:
        return rows
    # Inserts keep the keys unique, so no key is hot here.
    recorded = spark.read.schema(_TRANSLATION_SCHEMA).parquet(*added)
    return apply_translation(rows, recorded)


def _translations_path(version: int) -> str:
    return f"translations/v={version}"


def _new_folder(version: int, below: str | None = None) -> str:
    return f"{below or f'v={version}'}/c={uuid.uuid4().hex}"


def _write_counts(spark: SparkSession, root: str, folder: str) -> None:
    rows = _read_rows(spark, root, [folder])
    counts = rows.groupBy("stmt_type", "object_type").agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").parquet(f"{root}/counts/{folder}")


def read_inventory(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(stmt_type, object_type, n): scripts by kind, from the counts of each commit.

    Translations change no kind. No registry row is read, however large the registry.
    """
    folders = [c.folder for c in commits_of(spark, root, version) if c.kind != TRANSLATIONS]
    schema = "stmt_type string, object_type string, n long"
    if not folders:
        return spark.createDataFrame([], schema)
    counts = spark.read.schema(schema).parquet(*[f"{root}/counts/{folder}" for folder in folders])
    return counts.groupBy("stmt_type", "object_type").agg(F.sum("n").alias("n"))


def _remove(spark: SparkSession, path: str) -> None:
    target, fs = _file_system(spark, path)
    fs.delete(target, True)


def add_translations(updates: DataFrame, root: str, batch_ts: datetime | None = None) -> int:
    """Record translations of registered scripts: key, `target_sql`, `target_object_type` and
    perhaps `needs_review`. Rows without a text are no translation and are left out. Returns
    the version they were added to."""
    spark = updates.sparkSession
    version = latest_version(spark, root)
    if version is None:
        raise ValueError(f"no registry in {root}")
    stamp = F.current_timestamp() if batch_ts is None else F.lit(batch_ts)
    review = F.col("needs_review") if "needs_review" in updates.columns else F.lit(None).cast("boolean")
    rows = updates.where(F.col("target_sql").isNotNull()).select(
        *KEY, "target_sql", "target_object_type", stamp.alias("updated_ts"), review.alias("needs_review")
    )
    folder = _new_folder(version, _translations_path(version))
    rows.write.parquet(f"{root}/{folder}")
    while True:
        last = head(spark, root)
        now = latest_version(spark, root)
        if now != version:
            # A snapshot came between; it was read before these were there.
            moved = _new_folder(now, _translations_path(now))
            spark.read.schema(_TRANSLATION_SCHEMA).parquet(f"{root}/{folder}").write.parquet(f"{root}/{moved}")
            _remove(spark, f"{root}/{folder}")
            folder, version = moved, now
        if put(spark, root, Commit(last + 1, TRANSLATIONS, version, folder)):
            return version


def _write(rows: DataFrame, path: str, mode: str, rebalance: bool) -> None:
    laid_out = rows.select(
        *REGISTRY_COLUMNS,
        _folder(F.col("stmt_type"), _STMT_FOLDERS).alias("part_stmt"),
        _folder(F.col("object_type"), _OBJECT_FOLDERS).alias("part_object"),
    )
    if rebalance:
        # Sizes the files per folder and splits a folder that holds most rows (by AQE).
        laid_out = laid_out.hint("rebalance", *PARTITIONS)
    writer = laid_out.write.mode(mode).partitionBy(*PARTITIONS)
    writer.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)


def registry_insert(rows: DataFrame, root: str, since: int | None = None) -> int:
    """Add rows to the latest version (the first insert creates it), which is returned.

    `since` is the number of the last commit (`head`) that the rows were compared with; by
    default what is committed when the insert starts. Rows whose key others have committed
    after it are left out.
    """
    spark = rows.sparkSession
    since = head(spark, root) if since is None else since
    version = latest_version(spark, root) or 0
    folder = _new_folder(version)
    _write(rows, f"{root}/{folder}", "errorifexists", rebalance=True)
    _write_counts(spark, root, folder)
    while True:
        later = commits(spark, root, since)
        now = max((c.version for c in later), default=version)
        if now != version or any(c.kind != TRANSLATIONS for c in later):
            snapshot = any(c.kind == SNAPSHOT for c in later)
            # A snapshot holds what it was made of, and perhaps inserts of the same time.
            others = commits_of(spark, root) if snapshot else later
            folders = [c.folder for c in others if c.kind != TRANSLATIONS]
            known = _read_rows(spark, root, folders).select(*KEY).distinct()
            own = _read_rows(spark, root, [folder]).select(*REGISTRY_COLUMNS)
            moved = _new_folder(now)
            _write(own.join(known, KEY, "left_anti"), f"{root}/{moved}", "errorifexists", rebalance=True)
            _write_counts(spark, root, moved)
            for spent in (folder, f"counts/{folder}"):
                _remove(spark, f"{root}/{spent}")
            folder, version = moved, now
        since = max([since, *(c.number for c in later)])
        if put(spark, root, Commit(since + 1, INSERT, version, folder)):
            return version


def has_translations(spark: SparkSession, root: str) -> bool:
    """Whether translations were recorded since the latest version was written."""
    return any(c.kind == TRANSLATIONS for c in commits_of(spark, root))


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete all but the newest versions and the translations recorded for them."""
    path, fs = _file_system(spark, root)
    if not fs.exists(path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    versions = sorted(int(n[2:]) for n in names if re.fullmatch(r"v=\d+", n))
    newest = latest_version(spark, root)
    old = [v for v in versions if newest is not None and v <= newest][: -max(keep, 1)]
    for version in old:
        for folder in (f"{root}/v={version}", f"{root}/counts/v={version}", f"{root}/{_translations_path(version)}"):
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)
    return old


def write_snapshot(rows: DataFrame, root: str, rebalance: bool = True, since: int | None = None) -> int:
    """Write a full registry as the next version, which is returned.

    `since` is the number of the last commit (`head`) that the rows were read from, by
    default the last one when the snapshot starts. If others commit after it the snapshot
    would lose what they added: it is removed and a `ConflictError` raised. Rows that were
    read from a version and not shuffled since come folder by folder; they need no
    rebalancing.
    """
    spark = rows.sparkSession
    since = head(spark, root) if since is None else since
    version = latest_version(spark, root)
    version = 0 if version is None else version + 1
    folder = _new_folder(version)
    _write(rows, f"{root}/{folder}", "errorifexists", rebalance)
    _write_counts(spark, root, folder)
    if head(spark, root) != since or not put(spark, root, Commit(since + 1, SNAPSHOT, version, folder)):
        for spent in (folder, f"counts/{folder}"):
            _remove(spark, f"{root}/{spent}")
        raise ConflictError(f"commits after {since} in {root}")
    return version
