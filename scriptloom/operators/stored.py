"""Intermediate tables: written below the shared folder, read back, removed when spent."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scriptloom.session import remove_dir, work_dir


class Stored:
    """Tables of one run. A lost executor costs the tasks of one step, never the steps before."""

    def __init__(self):
        self._paths: dict[int, str] = {}

    def __call__(self, frame: DataFrame, label: str) -> DataFrame:
        spark = frame.sparkSession
        path = work_dir(spark, label)
        frame.write.parquet(path)
        read = spark.read.schema(frame.schema).parquet(path)
        self._paths[id(read)] = path
        return read

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for frame in frames:
            path = self._paths.pop(id(frame), None)
            if path:
                remove_dir(frame.sparkSession, path)
