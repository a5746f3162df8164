"""Script files in a stage folder.

Columns of a scan: `path`, `load_ts` (modification time as text), `md5`, `sql_body`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions.text import base_name
from scriptloom.schema import BATCH_LIMIT, PREVIEW_LIMIT, SCRIPT_PATTERN
from scriptloom.session import work_dir
from scriptloom.sources.files import LISTING, can_open, list_files, read_files

SCAN_COLUMNS = ["path", "load_ts", "md5", "sql_body"]


def matches_pattern(path: Column, pattern: str = SCRIPT_PATTERN) -> Column:
    """True when the whole path matches."""
    return F.rlike(path, F.lit(f"^(?:{pattern})$"))


def _plain_path() -> Column:
    # File metadata holds the path as a URI: undo its escapes, keep plus signs.
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _utc_text(time: Column) -> Column:
    """The time as text in UTC, whatever the zone of the session."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), time.cast("timestamp_ntz"))
    return utc.cast("string")


def decoded(content: Column) -> Column:
    """Text of a file's bytes: UTF-16 with a byte-order mark, or else UTF-8; no mark is kept."""
    mark = F.hex(F.substring(content, 1, 2))
    text = (
        F.when(mark == "FFFE", F.decode(content, "UTF-16LE"))
        .when(mark == "FEFF", F.decode(content, "UTF-16BE"))
        .otherwise(F.decode(content, "UTF-8"))
    )
    return F.regexp_replace(text, "^\ufeff", "")


def scan_scripts(
    spark: SparkSession,
    roots: str | Sequence[str],
    pattern: str = SCRIPT_PATTERN,
    glob: str = "*.sql",
    limit: int | None = None,
) -> DataFrame:
    """Every script under the roots whose path matches the pattern; the hash is of its bytes.

    The glob prunes while listing, the pattern decides on the whole path. With a
    limit the first paths in order are found from the listing alone, and only
    those files are opened. The stage is listed and read in tasks. Roots that only Spark's own
    readers can open are listed by those, on the driver.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    found = _found_roots(spark, roots)
    if found is None:
        return _scan_on_driver(spark, roots, pattern, glob, limit)
    listing = list_scripts(spark, found, pattern, glob)
    if len(found) > 1:
        # Roots may lie in one another.
        listing = listing.dropDuplicates(["path"])
    if limit is not None:
        listing = _first(listing, "path", limit)
    # The listing is wanted twice, for the number of tasks and by them.
    kept = work_dir(spark, "listing")
    listing.write.parquet(kept)
    return read_scripts(spark.read.schema(LISTING).parquet(kept)).select(*SCAN_COLUMNS)


def _found_roots(spark: SparkSession, roots: list[str]) -> list[str] | None:
    """Whole paths of the roots, wildcards resolved; None if one is not there or tasks cannot open it."""
    found = []
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        matches = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        names = [m.getPath().toString() for m in matches or []]
        if not names or not all(map(can_open, names)):
            return None
        found += names
    return found


def _first(files: DataFrame, order: str, limit: int) -> DataFrame:
    # Each task hands the driver its first rows, however few it holds: tasks are bounded.
    few = files.coalesce(files.sparkSession.sparkContext.defaultParallelism)
    return few.orderBy(order).limit(limit)


def _scan_on_driver(
    spark: SparkSession, roots: list[str], pattern: str, glob: str, limit: int | None
) -> DataFrame:
    if limit is not None:
        roots = _first_paths(spark, roots, pattern, glob, limit)
        if not roots:
            return spark.createDataFrame([], ", ".join(f"{c} string" for c in SCAN_COLUMNS))
    reader = spark.read.format("binaryFile")
    if limit is None:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return (
        reader.load(roots)
        .where(matches_pattern(_plain_path(), pattern))
        .select(
            _plain_path().alias("path"),
            _utc_text(F.col("modificationTime")).alias("load_ts"),
            F.md5("content").alias("md5"),
            decoded(F.col("content")).alias("sql_body"),
        )
    )


def _first_paths(
    spark: SparkSession, roots: list[str], pattern: str, glob: str, limit: int
) -> list[str]:
    # Selecting no content column makes this source list files without reading them.
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(roots)
        .where(matches_pattern(_plain_path(), pattern))
        .select(F.col("path").alias("uri"), _plain_path().alias("plain"))
    )
    return [_escape_glob(r.uri) for r in _first(listing, "plain", limit).collect()]


def _escape_glob(path: str) -> str:
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def list_scripts(
    spark: SparkSession, roots: str | Sequence[str], pattern: str = SCRIPT_PATTERN, glob: str = "*.sql"
) -> DataFrame:
    """Listing (path, modified_ms, length) of the scripts under the roots; none is opened."""
    return list_files(spark, roots, glob).where(matches_pattern(F.col("path"), pattern))


def read_scripts(files: DataFrame, opened: Accumulator | None = None) -> DataFrame:
    """Scan columns of listed scripts, and their modified_ms and length."""
    return read_files(files, opened).select(
        "path",
        _utc_text(F.timestamp_millis("modified_ms")).alias("load_ts"),
        F.md5("content").alias("md5"),
        decoded(F.col("content")).alias("sql_body"),
        "modified_ms",
        "length",
    )


def scan_in_tasks(
    spark: SparkSession, roots: str | Sequence[str], pattern: str = SCRIPT_PATTERN, glob: str = "*.sql"
) -> DataFrame:
    """As `scan_scripts` without a limit, whose listing is read anew by each run of the frame."""
    return read_scripts(list_scripts(spark, roots, pattern, glob)).select(*SCAN_COLUMNS)


def preview_scripts(spark: SparkSession, roots: str | Sequence[str], **options) -> DataFrame:
    """The first few scripts by path."""
    return scan_scripts(spark, roots, limit=PREVIEW_LIMIT, **options)


def batch_scripts(
    spark: SparkSession, roots: str | Sequence[str], limit: int | None = BATCH_LIMIT, **options
) -> DataFrame:
    """One run's worth of scripts by path; no limit means all."""
    return scan_scripts(spark, roots, limit=limit, **options)


def first_scripts(scripts: DataFrame, limit: int | None) -> DataFrame:
    """The first scripts of an already scanned frame, by path."""
    return scripts if limit is None else scripts.orderBy("path").limit(limit)


def tabulate(scripts: DataFrame) -> DataFrame:
    """Scan columns under their report names."""
    return scripts.select(
        F.col("path").alias("SQL_File_Name"),
        F.col("load_ts").alias("Load_Time"),
        F.col("md5").alias("MD5"),
        F.col("sql_body").alias("SQL_Body"),
    )


def with_file_name(scripts: DataFrame) -> DataFrame:
    return scripts.withColumn("sql_file_name", base_name(F.col("path")))
