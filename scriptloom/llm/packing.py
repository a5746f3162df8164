"""Best-fit packing of documents into sequences, with a bounded number of open bins.

Documents are tokenised where they lie. Every task then packs its pieces online: an open
bin is found by the smallest free space that still holds the piece, in a bitset with one bit
for each amount of free space; when too many bins are open the fullest closes. Bins that are
open when a task ends are packed again, as items, by fewer tasks, until one task is left: it
gets at most a fixed number of bins from each of a fixed number of tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import stored
from scriptloom.llm.stretches import byte_level_ids
from scriptloom.llm.stretches import byte_level_path as tokenizer_path
from scriptloom.llm.words import chunks

CAPACITY = 1024
#: Bins that a task keeps open, and pieces that it looks at together.
OPEN_BINS = 4096
WINDOW = 4096
#: Tasks whose open bins one task of the next round packs.
FAN_IN = 16
END_ID = 2


def batch_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows end to end, and where each row starts and ends."""
    ids, at, _ = byte_level_ids(column, path)
    return ids, at


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and `ids` if asked for).

    A document is its token ids and `end_id`. One longer than `capacity` is cut so that
    every piece but the first is full.
    """
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids binary" if keep_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for batch in chunks(batches, "text"):
            ids, at = batch_ids(batch.column("text"), path)
            row, piece, start, length, crc, blob = [], [], [], [], [], []
            for r in range(batch.num_rows):
                own = np.concatenate([ids[at[r] : at[r + 1]], end]).astype("<u4")
                a, k = 0, 0
                b = (len(own) - 1) % capacity + 1
                while a < len(own):
                    data = own[a:b].tobytes()
                    row.append(r), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(data))
                    if keep_ids:
                        blob.append(data)
                    a, b, k = b, b + capacity, k + 1
            columns = [
                batch.column("doc_id").take(pa.array(row, pa.int32())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(blob, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, schema)


class OpenBins:
    """Open bins by free space. `place` returns (bin, offset); `closed` tells what ended."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.mask, self.count, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.mask &= ~(1 << free)
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            into = self._take(free)
        else:
            free, into = self.capacity, self.made
            self.made += 1
            if self.count >= self.most and length < self.capacity:  # the fullest closes
                self._take((self.mask & -self.mask).bit_length() - 1)
        if left := free - length:
            self.by_free.setdefault(left, []).append(into)
            self.mask |= 1 << left
            self.count += 1
        return into, self.capacity - free

    def open(self) -> dict[int, int]:
        return {b: self.capacity - free for free, bins in self.by_free.items() for b in bins}


def _pack_task(batches, capacity: int, most: int, window: int):
    """Packs (item, length) rows of a task; yields item, bin, offset and, at the end, open bins."""
    task = TaskContext.get().partitionId() << 40
    bins = OpenBins(capacity, most)
    for batch in batches:
        lengths = batch.column("length").to_numpy()
        for low in range(0, len(lengths), window):
            part = lengths[low : low + window]
            into = np.empty(len(part), np.int64)
            offset = np.empty(len(part), np.int64)
            for i in np.argsort(-part, kind="stable").tolist():
                into[i], offset[i] = bins.place(int(part[i]))
            items = batch.slice(low, len(part)).column("item")
            yield pa.RecordBatch.from_arrays(
                [items, pa.array(into + task), pa.array(offset), pa.nulls(len(part), pa.int64())],
                ["item", "bin", "offset", "fill"],
            )
    if left := bins.open():
        ids = np.fromiter(left, np.int64, len(left)) + task
        fills = np.fromiter(left.values(), np.int64, len(left))
        none = pa.nulls(len(ids), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(ids), none, pa.array(fills)], ["item", "bin", "offset", "fill"])


def best_fit(items: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, window: int = WINDOW) -> DataFrame:
    """(item, length) rows get `sequence_id` and `offset`; `item` is a distinct long.

    Lengths must be between 1 and `capacity`. An empty table stays empty.
    """

    def task(batches):
        return _pack_task(batches, capacity, open_bins, window)

    schema = "item long, bin long, offset long, fill long"
    packed, _ = stored(items.select("item", "length").mapInArrow(task, schema), "pack-round")
    tasks = packed.where("fill is not null").select(F.shiftright("bin", 40).alias("t")).distinct().count()
    moves: list[DataFrame] = []
    last = packed
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        left = last.where("fill is not null").select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        dealt = left.repartition(tasks, F.xxhash64("item")) if tasks > 1 else left.coalesce(1)
        last, _ = stored(dealt.sortWithinPartitions("item").mapInArrow(task, schema), "pack-round")
        moves.append(last.where("item is not null").select("item", "bin", "offset"))
        if tasks > 1:
            tasks = last.where("fill is not null").select(F.shiftright("bin", 40).alias("t")).distinct().count()
    where = packed.where("item is not null").select("item", F.lit(0).alias("round"), "bin", "offset")
    for number, move in enumerate(moves, 1):
        to = move.select(F.col("item").alias("_from"), F.col("bin").alias("_to"), F.col("offset").alias("_by"))
        moved = F.col("_to").isNotNull()
        where = where.join(to, (F.col("bin") == F.col("_from")) & (F.col("round") == number - 1), "left").select(
            "item",
            F.when(moved, number).otherwise(F.col("round")).alias("round"),
            F.when(moved, F.col("_to")).otherwise(F.col("bin")).alias("bin"),
            (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset"),
        )
    # Bins of different rounds have numbers of their own.
    rounds = len(moves) + 1
    return where.select("item", (F.col("bin") * rounds + F.col("round")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Packs documents (doc_id, text): a row per piece, with sequence_id and offset.

    A null or empty text is the end id alone. Repeated rows are packed each; a null doc_id
    is carried. Other columns are not read. An empty table gives an empty result.
    """
    pieces = token_pieces(docs, capacity, path, keep_ids=keep_ids)
    kept, _ = stored(pieces.withColumn("_item", F.monotonically_increasing_id()), "pack-pieces")
    placed = best_fit(kept.select(F.col("_item").alias("item"), "length"), capacity)
    return kept.join(placed, F.col("_item") == F.col("item")).drop("_item", "item")
