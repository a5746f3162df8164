"""What a registry has taken in from its stage: path, time, length and hash of each file.

A file whose path, time and length are in the manifest is not opened again. Rows are added
after the registry has committed, and only for scripts that it holds: what failed, or was
left out by a limit, is read again by the next run. A run that ends between the two reads
its files once more and finds them registered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions.text import base_name
from scriptloom.sources.registry import path_exists, read_registry

MANIFEST = "path string, modified_ms long, length long, md5 string"
_SEEN = ["path", "modified_ms", "length"]


def manifest_path(registry: str) -> str:
    return f"{registry}/stage_manifest"


def read_manifest(spark: SparkSession, registry: str) -> DataFrame:
    path = manifest_path(registry)
    if not path_exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(path)


def changed_files(listing: DataFrame, registry: str) -> DataFrame:
    """The listed files that the registry has not taken in as they are now.

    A file that was rewritten with the same length in the same millisecond goes unnoticed.
    """
    seen = read_manifest(listing.sparkSession, registry).select(*_SEEN).distinct()
    return listing.join(seen, _SEEN, "left_anti")


def record_files(scanned: DataFrame, registry: str) -> None:
    """Adds the scanned files (path, modified_ms, length, md5) whose scripts are registered."""
    held = read_registry(scanned.sparkSession, registry, translations=False)
    held = held.select(F.col("sql_file_name").alias("name"), F.col("_stg_sql_file_md5").alias("md5")).distinct()
    rows = scanned.select(*_SEEN, "md5", base_name(F.col("path")).alias("name"))
    taken = rows.join(held, ["name", "md5"], "left_semi").select(*_SEEN, "md5")
    taken.write.mode("append").parquet(manifest_path(registry))
