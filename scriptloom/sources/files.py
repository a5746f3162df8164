"""Files of a stage, listed and read in tasks.

The driver looks at the upper folders only, until there are enough of them to share out.
Each is a partition of a data source that lists what lies below it. Contents are read by
tasks that are cut by the bytes they open, not by folder, so that a folder with most of the
files does not end up in one task.
"""

from __future__ import annotations

import fnmatch
import json
import os
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "path string, modified_ms long, length long"
#: The driver goes down the folders until it has found so many.
FOLDERS = 1024
#: Files of a local folder that a task looks at, and the most tasks that share one.
FOLDER_FILES = 50_000
SLICES = 256
ROWS = 10_000
#: Bytes of contents that a task opens, and hands on at once.
TASK_BYTES = 128 << 20
BATCH_BYTES = 8 << 20

# Schemes that Spark and the readers here have different names for.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "": "file"}


@cache
def _file_system(scheme: str, authority: str) -> pafs.FileSystem:
    if scheme == "file":
        return pafs.LocalFileSystem()
    try:
        return pafs.FileSystem.from_uri(f"{scheme}://{authority}")[0]
    except pa.ArrowInvalid as error:
        raise ValueError(f"no reader for files of {scheme}://{authority}") from error


def _split(path: str) -> tuple[str, pafs.FileSystem, str]:
    """What stands before the paths of a file system, that system, and the path in it."""
    found = urlsplit(path) if "://" in path or path.startswith("file:") else None
    scheme, authority = (found.scheme, found.netloc) if found else ("", "")
    inside = path[len(scheme) + 1 :].removeprefix("//") if scheme else path
    kind = _SCHEMES.get(scheme, scheme)
    if kind == "file":
        return "file:", pafs.LocalFileSystem(), inside
    system = _file_system(kind, authority)
    if kind == "s3":
        return f"{scheme}://", system, inside  # the bucket is part of the path
    return f"{scheme}://{authority}", system, inside[len(authority) :]


def can_open(path: str) -> bool:
    """Whether the file system of a path is one that tasks can read, and the path is in it."""
    try:
        _, system, inside = _split(path)
        return system.get_file_info(inside).type != pafs.FileType.NotFound
    except (OSError, ValueError, NotImplementedError):
        return False


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _entries(system: pafs.FileSystem, folder: str) -> Iterator[pafs.FileInfo]:
    for info in system.get_file_info(pafs.FileSelector(folder, recursive=False)):
        if not _hidden(info.base_name):
            yield info


def _contents(system: pafs.FileSystem, folder: str) -> tuple[list[str], int]:
    """The folders in a folder, and the tasks that share its files. Of local files only the names are read."""
    if not isinstance(system, pafs.LocalFileSystem):
        return [e.path for e in _entries(system, folder) if e.type == pafs.FileType.Directory], 1
    below, files = [], 0
    with os.scandir(folder) as entries:
        for entry in entries:
            if not entry.is_dir():
                files += 1
            elif not _hidden(entry.name):
                below.append(entry.path)
    return below, max(1, min(SLICES, -(-files // FOLDER_FILES)))


@dataclass
class Folder(InputPartition):
    """A folder to list: all that lies below, or only its own files, or of those a slice by name."""

    path: str
    deep: bool
    slice: int = 0
    slices: int = 1


class StageReader(DataSourceReader):
    def __init__(self, options):
        self.roots = json.loads(options["roots"])
        self.glob = options.get("glob", "*")
        self.folders = int(options.get("folders", FOLDERS))

    def partitions(self) -> list[Folder]:
        level, shallow = [], []
        for root in self.roots:
            lead, system, path = _split(root)
            info = system.get_file_info(path)
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(root)
            level.append(lead + path.rstrip("/"))
        while level and len(level) + len(shallow) < self.folders:
            below, own = [], []
            for folder in level:
                lead, system, path = _split(folder)
                slices = 1
                if system.get_file_info(path).type == pafs.FileType.Directory:
                    found, slices = _contents(system, path)
                    below += [lead + e for e in found]
                own += [Folder(folder, False, k, slices) for k in range(slices)]
            shallow += own
            level = below
        return shallow + [Folder(p, True) for p in level]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        lead, system, start = _split(partition.path)
        rows: list[tuple] = []
        todo = [start]
        while todo:
            folder = todo.pop()
            if isinstance(system, pafs.LocalFileSystem) and os.path.isdir(folder):
                yield from self._local_rows(lead, folder, partition, todo)
                continue
            info = system.get_file_info(folder)
            for entry in [info] if info.is_file else _entries(system, folder):
                if entry.type == pafs.FileType.Directory and partition.deep:
                    todo.append(entry.path)
                # A file without content has no record.
                if entry.is_file and entry.size and fnmatch.fnmatchcase(entry.base_name, self.glob):
                    rows.append((lead + entry.path, entry.mtime_ns // 1_000_000, entry.size))
                if len(rows) >= ROWS:
                    yield _rows(rows)
                    rows = []
        yield _rows(rows)

    def _local_rows(self, lead: str, folder: str, partition: Folder, todo: list[str]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        with os.scandir(folder) as entries:
            for entry in entries:
                if partition.slices > 1 and zlib.crc32(os.fsencode(entry.name)) % partition.slices != partition.slice:
                    continue
                if _hidden(entry.name):
                    continue
                if entry.is_dir():
                    if partition.deep:
                        todo.append(entry.path)
                elif fnmatch.fnmatchcase(entry.name, self.glob) and entry.is_file():
                    try:
                        info = entry.stat()
                    except FileNotFoundError:
                        continue  # removed while it was listed
                    if info.st_size:
                        rows.append((lead + entry.path, info.st_mtime_ns // 1_000_000, info.st_size))
                if len(rows) >= ROWS:
                    yield _rows(rows)
                    rows = []
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    path, modified, length = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(path, pa.string()), pa.array(modified, pa.int64()), pa.array(length, pa.int64())],
        ["path", "modified_ms", "length"],
    )


class StageFiles(DataSource):
    """Paths, times in milliseconds and lengths of the files below some folders."""

    @classmethod
    def name(cls) -> str:
        return "scriptloom_stage"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> StageReader:
        return StageReader(self.options)


def list_files(spark: SparkSession, roots: str | Sequence[str], glob: str = "*", folders: int = FOLDERS) -> DataFrame:
    """(path, modified_ms, length) of the files below the roots whose name matches the glob.

    No file is opened, and no path but those of upper folders comes to the driver.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    spark.dataSource.register(StageFiles)
    reader = spark.read.format(StageFiles.name()).option("roots", json.dumps(roots))
    return reader.option("glob", glob).option("folders", str(folders)).load()


def read_files(files: DataFrame, opened: Accumulator | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The listed files with their `content`. `opened` counts the files that are opened."""
    total = files.agg(F.sum("length").alias("t")).first()["t"] or 0
    least = files.sparkSession.sparkContext.defaultParallelism if total else 1
    tasks = max(least, -(-total // task_bytes))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, size, first = [], 0, 0
            for k, path in enumerate(batch.column("path").to_pylist()):
                _, system, inside = _split(path)
                with system.open_input_file(inside) as file:
                    contents.append(file.read())
                if opened is not None:
                    opened.add(1)
                size += len(contents[-1])
                if size >= BATCH_BYTES:
                    yield _with(batch.slice(first, k + 1 - first), contents)
                    contents, size, first = [], 0, k + 1
            if contents:
                yield _with(batch.slice(first), contents)

    dealt = files.select("path", "modified_ms", "length").repartition(tasks, "path")
    return dealt.mapInArrow(read, f"{LISTING}, content binary")


def _with(batch: pa.RecordBatch, contents: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(contents, pa.binary())], [*batch.schema.names, "content"])
