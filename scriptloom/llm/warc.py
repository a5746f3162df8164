"""WARC archives and a two-level capture index.

Pages are written as gzipped WARC records, a gzip member each; of equal payloads the first is
a response and the others revisit it. The index sorts captures by their reversed-host key
into compressed blocks, with a sparse directory of the blocks' first keys at the end of each
index file. A lookup finds the file and then the block by binary search, reads that range
only, and the records it names are range reads in their archives.

Tasks write files under names of their own attempt; what counts is the table of what a
finished stage has written, so a task that runs again leaves an unread file at worst.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm.common import folder, spread_left_join, stored
from scriptloom.llm.words import chunks

#: Schemes that Spark and the writer of archives have different names for.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 100
ARCHIVE_BYTES = 256 << 20
#: Captures of an index block, and bytes of one range read.
BLOCK_LINES = 1024
READ_BYTES = 4 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that driver and executors share, and the path in it."""
    scheme, mark, rest = path.partition("://")
    if mark and scheme in _SCHEMES:
        path = f"{_SCHEMES[scheme]}://{rest}"
    try:
        return pafs.FileSystem.from_uri(path)
    except pa.ArrowInvalid as error:
        raise ValueError(f"archives cannot be written below {path}: {error}") from error


def url_key(url: Column) -> Column:
    """Host reversed and comma-separated, then `)`, then path and query; '' for null.

    Scheme, user, port and fragment are dropped and the host is lower-cased.
    """
    whole = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::[0-9]*)?([^#]*)"
    host = F.lower(F.regexp_extract(url, whole, 1))
    return F.coalesce(
        F.concat(
            # An address in brackets stays whole.
            F.when(host.startswith("["), host).otherwise(F.array_join(F.reverse(F.split(host, r"\.")), ",")),
            F.lit(")"),
            F.regexp_extract(url, whole, 2),
        ),
        F.lit(""),
    )


def _head(fields: list[tuple[str, str]]) -> bytes:
    clean = [(k, v.replace("\r", "%0D").replace("\n", "%0A")) for k, v in fields]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + "\r\n").encode()


def _record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if revisit:
        fields.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    fields.append(("Content-Length", str(len(block))))
    return _head(fields) + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a WARC record and its payload: whole for a response, None for a revisit."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, body = block.split(b"\r\n\r\n", 1)
    length = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError("payload does not agree with its record")

    def number(name: str):
        value = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields["WARC-Target-URI"],
        "type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "bytes": length,
        "digest": digest,
        "payload": None if revisit else body,
    }


def _member(data: bytes) -> bytes:
    maker = zlib.compressobj(6, zlib.DEFLATED, 31)
    return maker.compress(data) + maker.flush()


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes pages (page_id long, url, html) below `path`; the captures, as a stored table.

    Captures are key, page_id, file, offset, length. A null html is an empty payload and a
    null url an empty one. Of equal payloads (by SHA-256 and length) of at least `least`
    bytes the smallest page_id is the response; rows that repeat it are responses too, and a
    null page_id is never revisited. Other columns are not read.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        payload.alias("html"),
        F.sha2(payload, 256).alias("sha"),
        F.octet_length(payload).alias("bytes"),
    )
    heads, _ = stored(
        rows.where(F.col("bytes") >= least)
        .groupBy("sha", "bytes")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first is not null"),
        "warc-heads",
    )
    joined = spread_left_join(rows, heads, ["sha", "bytes"], ["page_id", "url"])
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    out = joined.select("page_id", "url", url_key(F.col("url")).alias("key"), "html", "sha", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(path)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get().partitionId()
        stream, name, at = None, "", 0
        try:
            # Pages become Python objects a few megabytes at a time.
            for batch in chunks(batches, "html"):
                made = []
                for row in batch.select(["page_id", "url", "html", "sha", "refers_to"]).to_pylist():
                    if stream is None or at >= ARCHIVE_BYTES:
                        if stream is not None:
                            stream.close()
                        name, at = f"pages-{task:06d}-{uuid.uuid4().hex}.warc.gz", 0
                        stream = fs.open_output_stream(f"{base}/{name}", compression=None)
                    data = _member(_record(row["page_id"], row["url"], row["html"].encode(), row["sha"], row["refers_to"]))
                    stream.write(data)
                    made.append((name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"),
                        batch.column("page_id"),
                        *[pa.array(x, t) for x, t in zip(zip(*made), (pa.string(), pa.int64(), pa.int64()))],
                    ],
                    ["key", "page_id", "file", "offset", "length"],
                ) if made else batch.slice(0, 0).select(["key", "page_id"]).append_column(
                    "file", pa.nulls(0, pa.string())
                ).append_column("offset", pa.nulls(0, pa.int64())).append_column("length", pa.nulls(0, pa.int64()))
        finally:
            if stream is not None:
                stream.close()

    captures, _ = stored(
        out.mapInArrow(write, "key string, page_id long, file string, offset long, length long"), "warc-captures"
    )
    return captures


def write_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> list[dict]:
    """Writes the index of captures below `path`: a list of its files, one for each range of keys.

    A file holds compressed blocks of sorted lines and, last, the directory of the blocks:
    first key, offset, length. The list has first and last key, name and place of the
    directory of each file; it has as many entries as the sort has partitions.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(path)
        fs.create_dir(base, recursive=True)
        name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx"
        stream, at, directory, lines, last = None, 0, [], [], ""

        def flush():
            nonlocal at, lines
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            directory.append((lines[0][0], at, len(data)))
            stream.write(data)
            at += len(data)
            lines = []

        try:
            for batch in batches:
                for line in zip(*[c.to_pylist() for c in batch.columns]):
                    if stream is None:
                        stream = fs.open_output_stream(f"{base}/{name}", compression=None)
                    lines.append(line)
                    last = line[0]
                    if len(lines) == block_lines:
                        flush()
            if lines:
                flush()
            if directory:
                data = zlib.compress(json.dumps(directory).encode())
                stream.write(data)
                row = [[directory[0][0]], [last], [name], [at], [len(data)]]
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(row, kinds)], ["first", "last", "file", "offset", "length"]
                )
        finally:
            if stream is not None:
                stream.close()

    order = [F.col("key"), F.col("page_id"), F.col("file"), F.col("offset")]
    sorted_ = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    files, _ = stored(
        sorted_.mapInArrow(write, "first string, last string, file string, offset long, length long"), "warc-index"
    )
    # Spark orders strings by their UTF-8 bytes, Python by code points: that is the same order.
    return sorted((r.asDict() for r in files.collect()), key=lambda r: (r["first"], r["last"]))


class CaptureIndex:
    """Lookups in one task. Directories are read when a key first falls into their file."""

    def __init__(self, files: list[dict], path: str, keep: int = 4):
        self.files, self.keep = files, keep
        self.fs, self.base = opened(path)
        self.firsts = [f["first"] for f in files]
        self.lasts = [f["last"] for f in files]
        self.directories: dict[int, tuple[list, list]] = {}
        self.block: tuple[tuple, list] = ((), [])

    def _read(self, name: str, offset: int, length: int) -> bytes:
        with self.fs.open_input_file(f"{self.base}/{name}") as f:
            f.seek(offset)
            return zlib.decompress(f.read(length))

    def _directory(self, number: int) -> tuple[list, list]:
        if number not in self.directories:
            if len(self.directories) >= self.keep:
                self.directories.pop(next(iter(self.directories)))
            f = self.files[number]
            blocks = json.loads(self._read(f["file"], f["offset"], f["length"]))
            self.directories[number] = ([b[0] for b in blocks], blocks)
        return self.directories[number]

    def find(self, key: str) -> Iterator[list]:
        """The captures of a key, in order."""
        number = bisect.bisect_left(self.lasts, key)
        while number < len(self.files) and self.firsts[number] <= key:
            firsts, blocks = self._directory(number)
            at = max(bisect.bisect_left(firsts, key) - 1, 0)
            while at < len(blocks) and firsts[at] <= key:
                place = (number, at)
                if self.block[0] != place:
                    lines = self._read(self.files[number]["file"], *blocks[at][1:]).decode().split("\n")
                    self.block = (place, [json.loads(x) for x in lines])
                held = self.block[1]
                for i in range(bisect.bisect_left(held, key, key=lambda x: x[0]), len(held)):
                    if held[i][0] != key:
                        break
                    yield held[i]
                at += 1
            number += 1


def look_up(keys: DataFrame, files: list[dict], path: str) -> DataFrame:
    """The captures of the distinct keys (key), found in the index."""
    # As many entries as the index has files, which is one for each task of its sort.
    sent = keys.sparkSession.sparkContext.broadcast(files)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(sent.value, path)
        for batch in batches:
            rows: list = []
            for key in batch.column("key").to_pylist():
                for capture in index.find(key):
                    rows.append(capture)
                    if len(rows) == 65536:
                        yield _captures(rows)
                        rows = []
            yield _captures(rows)

    return keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(
        find, "key string, page_id long, file string, offset long, length long"
    )


def _captures(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    columns = zip(*rows) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(list(v), k) for v, k in zip(columns, kinds)], ["key", "page_id", "file", "offset", "length"]
    )


def read_records(captures: DataFrame, path: str, payloads: bool = False) -> DataFrame:
    """The records of captures, by range reads of their archives; neighbours are read together.

    Payloads of responses are checked against length and digest; they are returned as
    `payload` (binary, null for a revisit) if asked for.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(path)
        name, stream = None, None
        try:
            for batch in batches:
                files = batch.column("file").to_pylist()
                offsets, lengths = batch.column("offset").to_numpy(), batch.column("length").to_numpy()
                i = 0
                while i < len(files):
                    j = i + 1
                    while (
                        j < len(files) and files[j] == files[i] and offsets[j] == offsets[j - 1] + lengths[j - 1]
                        and offsets[j] + lengths[j] - offsets[i] <= READ_BYTES
                    ):
                        j += 1
                    if files[i] != name:
                        if stream is not None:
                            stream.close()
                        name, stream = files[i], fs.open_input_file(f"{base}/{files[i]}")
                    stream.seek(int(offsets[i]))
                    data = stream.read(int(offsets[j - 1] + lengths[j - 1] - offsets[i]))
                    found = []
                    for k in range(i, j):
                        low = int(offsets[k] - offsets[i])
                        found.append(parse_record(zlib.decompress(data[low : low + int(lengths[k])], 31)))
                    yield _records(found, payloads)
                    i = j
        finally:
            if stream is not None:
                stream.close()

    # A stretch of an archive is one task's, whatever the number of archives.
    stretch = F.floor(F.col("offset") / (4 * READ_BYTES)).alias("stretch")
    dealt = captures.select("file", "offset", "length", stretch).repartition("file", "stretch").sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, type string, refers_to long, bytes long, digest string"
    return dealt.mapInArrow(read, schema + (", payload binary" if payloads else ""))


def _records(found: list[dict], payloads: bool) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "type": pa.string(), "refers_to": pa.int64(), "bytes": pa.int64(), "digest": pa.string()}
    if payloads:
        kinds["payload"] = pa.binary()
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in kinds.items()], list(kinds))


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes archives and index, and reads every record back through the index.

    page_id, payload_bytes, payload_digest, record_type, refers_to, one row per page. An
    empty table writes nothing and gives an empty result.
    """
    spark: SparkSession = pages.sparkSession
    path = path or folder(spark, "warc")
    captures = write_archives(pages, path)
    files = write_index(captures, path)
    keys = captures.select("key").distinct()
    found, _ = stored(look_up(keys, files, path), "warc-found")
    return read_records(found, path).select(
        "page_id",
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )
