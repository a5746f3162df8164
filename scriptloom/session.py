"""Session defaults and the shared folder for materialised intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "scriptloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster leave ``master`` to spark-submit and give ``shuffle_partitions``
    generously (AQE coalesces what turns out too small; it cannot split an
    aggregate's partition that turns out too large).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Do not look up the call site of each of the many column expressions.
        "spark.sql.dataFrameQueryContext.enabled": "false",
        # Script bodies are wide: keep Arrow batches small in rows.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        # Scripts are small files: pack thousands of them into one scan task.
        "spark.sql.files.openCostInBytes": str(64 * 1024),
        **conf,
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="scriptloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster
    session must name one, because a folder on one machine is lost with it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        # The executors of local-cluster[...] are processes of their own.
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _local_folder()
    return f"{base.rstrip('/')}/scriptloom/{label}-{uuid.uuid4().hex}"
