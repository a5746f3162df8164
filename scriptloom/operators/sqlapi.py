"""Running SQL text with a memo of results."""

from __future__ import annotations

import hashlib
from collections import OrderedDict

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SqlMemo:
    """SQL text to frame; the same query over the same files gives the same frame.

    Queries are the same when their plans are, whatever their blanks, comments and case of
    keywords; the files are the same when their paths, lengths and times are. When an input
    has changed the old result is released and the query runs again. A command runs once
    for its text.

    Anything that fails, be it a text that is no string, bad SQL or an error while
    the query is planned, gives an empty frame without columns. A result is kept on the
    executors, as far as it was read, never on the driver; the least recently used one is
    released.
    """

    def __init__(self, spark: SparkSession, size: int = 32):
        self._spark = spark
        self._size = size
        # By the hash of a plan: the fingerprint of its files, the query and its result.
        self._memo: OrderedDict[int | str, tuple[str, DataFrame, DataFrame]] = OrderedDict()

    def _empty(self) -> DataFrame:
        return self._spark.createDataFrame([], T.StructType([]))

    def _files(self, frame: DataFrame) -> str:
        """A digest of the files that a query reads, with their lengths and times."""
        jvm, conf = self._spark._jvm, self._spark._jsc.hadoopConfiguration()
        digest = hashlib.sha256()
        # The plan as analysed: one that is found in the cache shows no files.
        leaves = frame._jdf.queryExecution().analyzed().collectLeaves()
        names = set()
        for k in range(leaves.size()):
            leaf = leaves.apply(k)
            if leaf.getClass().getSimpleName() == "LogicalRelation":
                relation = leaf.relation()
                if relation.getClass().getSimpleName() == "HadoopFsRelation":
                    names.update(relation.location().inputFiles())
        for name in sorted(names):
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
            status = path.getFileSystem(conf).getFileStatus(path)
            digest.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
        return digest.hexdigest()

    def _keep(self, key: int | str, files: str, frame: DataFrame, result: DataFrame) -> DataFrame:
        self._memo[key] = (files, frame, result)
        if len(self._memo) > self._size:
            _, (_, _, oldest) = self._memo.popitem(last=False)
            oldest.unpersist()
        return result

    def query(self, text: str) -> DataFrame:
        if not isinstance(text, str):
            return self._empty()
        if text in self._memo:  # a command
            self._memo.move_to_end(text)
            return self._memo[text][2]
        try:
            frame = self._spark.sql(text)
            analysed, run = frame._jdf.queryExecution().analyzed(), frame._jdf.queryExecution().commandExecuted()
            if "Command" in analysed.getClass().getSimpleName() + run.getClass().getSimpleName():
                return self._keep(text, "", frame, frame)
            key, files = frame.semanticHash(), self._files(frame)
            if key in self._memo:
                had, same, result = self._memo[key]
                if had == files and frame.sameSemantics(same) and frame.columns == result.columns:
                    self._memo.move_to_end(key)
                    return result
                del self._memo[key]
                result.unpersist()
            # Plan it and read one row, so that most errors show here; then keep what is read.
            frame.limit(1).write.format("noop").mode("overwrite").save()
            return self._keep(key, files, frame, frame.cache())
        except (PySparkException, Py4JJavaError) as error:
            print(f"query failed: {error}")
            return self._empty()

    def single_column(self, text: str) -> DataFrame:
        """Column `name` of a query's result, null where it has no such column."""
        result = self.query(text)
        if "name" in result.columns:
            return result.select("name")
        return result.select(F.lit(None).cast("string").alias("name"))
