"""Mixture-controlled packing by deficit round-robin over the sources.

Documents wait in a queue for each source, in an order that a hash of their ids gives. A
window is a number of sequences. In every window each source is credited a quantum, its
share of the window's tokens, and sends packets of its documents as far as the credit goes;
what is left of the credit, less than a packet, is carried into the next window. A source
has been credited k quanta by its k-th window, so a packet goes into the first window whose
credits cover the queue up to its end. That depends on the packet's place in its queue only,
and running sums give the places: no task sees a whole queue, and a deficit is carried across
partitions as it is across windows. A queue that has run dry leaves its share to the others.

Windows lie end to end and are cut into sequences, every one full. The tokens left at the
very end make sequences of a power of two each, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import remove, stored
from scriptloom.llm.stretches import byte_level, byte_level_ids, byte_level_path, joined
from scriptloom.llm.words import chunks

CAPACITY = 1024
#: Sequences of a window: over each run of so many the sources have their target shares.
WINDOW = 64
#: Longest packet: no source of a window is off its target by as much.
PACKET = 128
END_ID = 0
SEED = 42


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, source, n, ids): each document's ids and `end_id`, as little-endian numbers."""
    wide = max(byte_level(path).get_vocab_size(), end_id + 1) > 1 << 16
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, n long, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype("<u4" if wide else "<u2")
        for batch in chunks(batches, "text"):
            ids, at, _ = byte_level_ids(batch.column("text"), path)
            n = np.diff(at) + 1
            ups = joined(n)
            every = np.full(ups[-1], end_id, kind)
            own = np.ones(len(every), bool)
            own[ups[1:] - 1] = False
            every[own] = ids
            offsets = pa.py_buffer((ups * kind.itemsize).astype("<i4").tobytes())
            blobs = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(every.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(n), blobs], ["doc_id", "source", "n", "ids"]
            )

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), text).mapInArrow(encode, schema)


def running_sums(rows: DataFrame, group: list[str], order: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Adds `begin`, the sum of `n` over the rows before in a group's order; and sums by group.

    `order` must tell the rows of a group apart. Rows are dealt by ranges, summed within
    them, and moved up by the sums of the ranges before, of which a table has one row for
    each group and one more for each range. No group meets in one task.
    """
    keys = [*group, *order]
    narrow = rows.select(*rows.columns)
    place = narrow.columns.index("n")
    group_places = [narrow.columns.index(c) for c in group]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, upto = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(place).to_numpy()
            new = np.zeros(len(n), bool)
            for k in group_places:
                codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            key = [batch.column(k)[0].as_py() for k in group_places]
            new[0] = key != last
            total = np.cumsum(n)
            before = total - n
            begins = np.where(new, before, 0)
            starts = np.maximum.accumulate(begins)
            # Rows that go on with the group of the batch before are moved up by its sum.
            moved = np.where(np.cumsum(new) == 0, upto, 0)
            within = before - starts + moved
            last, upto = [batch.column(k)[-1].as_py() for k in group_places], int(within[-1] + n[-1])
            parts = pa.array(np.full(len(n), part, np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, parts, pa.array(within)], [*batch.schema.names, "_part", "_within"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields)
    dealt = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt, _ = stored(dealt.mapInArrow(sums, f"{schema}, _part int, _within long"), label)
    counts = dealt.groupBy(*group, "_part").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    to = bases.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_part").alias("_to"), "_base")
    same = F.col("_part") == F.col("_to")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = dealt.join(to, same).withColumn("begin", F.col("_base") + F.col("_within"))
    totals = counts.groupBy(*group).agg(F.sum("_n").alias("total"))
    return placed.select(*narrow.columns, "begin"), totals


def _by_window(begin: Column, n: Column, quantum: Column, packet: int) -> Column:
    """A document's packets by window: an array of (window, start), one for each window."""
    last = F.sequence(F.lit(1), F.ceil(n / packet))
    windows = F.transform(last, lambda k: F.ceil((begin + F.least(k * packet, n)) / quantum) - 1)
    return F.element_at(
        F.transform(
            F.array(windows),
            lambda ws: F.filter(
                F.transform(
                    ws,
                    lambda w, i: F.struct(
                        F.greatest(w, F.lit(0)).cast("long").alias("window"),
                        (i.cast("long") * packet).alias("start"),
                        F.coalesce(F.get(ws, i - 1) != w, F.lit(True)).alias("first"),
                    ),
                ),
                lambda p: p["first"],
            ),
        ),
        1,
    )


def schedule(docs: DataFrame, weights: DataFrame | None, capacity: int, window: int, packet: int) -> DataFrame:
    """(row, source, n, tie) documents as (row, source, window, start, n, at) pieces: which
    tokens of a document go into which window, and where its source's queue has them."""
    queued, totals = running_sums(docs, ["source"], ["tie", "row"], "mix-queues")
    if weights is None:
        goal = totals.withColumn("weight", F.col("total").cast("double"))
    else:
        given = weights.where("weight > 0").groupBy(F.col("source").alias("_s")).agg(F.max("weight").alias("weight"))
        least = given.agg(F.min("weight").alias("w")).first()["w"] or 1.0
        goal = totals.join(given, F.col("source").eqNullSafe(F.col("_s")), "left")
        goal = goal.withColumn("weight", F.coalesce("weight", F.lit(least)).cast("double"))
    goal, _ = stored(goal.select("source", "weight"), "mix-goals")
    whole = goal.agg(F.sum("weight").alias("w")).first()["w"] or 1.0
    quanta = goal.select(F.col("source").alias("_s"), (F.col("weight") / whole * (capacity * window)).alias("quantum"))
    rows = queued.join(quanta, F.col("source").eqNullSafe(F.col("_s")))
    parts = rows.withColumn("parts", _by_window(F.col("begin"), F.col("n"), F.col("quantum"), packet))
    pieces = F.transform(
        "parts",
        lambda p, i: F.struct(
            p["window"].alias("window"),
            p["start"].alias("start"),
            (F.coalesce(F.get("parts", i + 1)["start"], F.col("n")) - p["start"]).alias("n"),
        ),
    )
    return parts.select("row", "source", "begin", F.inline(pieces)).select(
        "row", "source", "window", "start", "n", (F.col("begin") + F.col("start")).alias("at")
    )


def _last_sequences(total: int, capacity: int) -> list[tuple[int, int, int]]:
    """(number, begin, size) of the sequences after the full ones: a power of two each."""
    full, left = divmod(total, capacity)
    out, begin = [], full * capacity
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            out.append((full + len(out), begin, 1 << bit))
            begin += 1 << bit
    return out


def _cut(pieces: DataFrame, total: int, capacity: int) -> DataFrame:
    """Pieces with their `begin` in the stream of all tokens, cut into sequences."""
    full = total // capacity * capacity
    begin, end = F.col("begin"), F.col("begin") + F.col("n")

    def sequence(number, start, size):
        return F.struct(
            F.lit(number).cast("long").alias("sequence_id"),
            F.lit(start).cast("long").alias("low"),
            F.lit(size).cast("long").alias("size"),
        )

    kind = "array<struct<sequence_id:bigint,low:bigint,size:bigint>>"
    numbers = F.sequence(F.floor(begin / capacity), F.floor((F.least(end, F.lit(full)) - 1) / capacity))
    whole = F.when(
        begin < full, F.transform(numbers, lambda k: sequence(k, k * capacity, F.lit(capacity)))
    ).otherwise(F.array().cast(kind))
    rest = F.filter(
        F.array(*[sequence(*s) for s in _last_sequences(total, capacity)]).cast(kind),
        lambda s: (s["low"] < end) & (s["low"] + s["size"] > begin),
    )
    cut = pieces.withColumn("_piece_begin", begin).withColumn("_piece_end", end)
    cut = cut.select("row", "window", "start", "_piece_begin", "_piece_end", F.inline(F.concat(whole, rest)))
    low = F.greatest("_piece_begin", "low")
    return cut.select(
        "row",
        "window",
        (F.col("start") + low - F.col("_piece_begin")).alias("start"),
        (F.least("_piece_end", F.col("low") + F.col("size")) - low).alias("length"),
        "sequence_id",
        (low - F.col("low")).alias("offset"),
    )


def pack_mixture(
    docs: DataFrame,
    weights: DataFrame | None = None,
    capacity: int = CAPACITY,
    window: int = WINDOW,
    packet: int = PACKET,
    path: str | None = None,
    end_id: int = END_ID,
    seed: int = SEED,
    keep_ids: bool = False,
) -> DataFrame:
    """Packs documents (doc_id, text, source): a row per piece, with its sequence and window.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, window
    and, if asked for, `ids` (little-endian 32-bit). Every token lies in one piece, every
    sequence but those of the last few tokens is full, and those have a power of two each.

    `weights` (source, weight) are the target proportions; without them each source gets its
    share of all tokens, so that every window is mixed like the whole. A source that the
    weights leave out, or give nothing, counts with the least weight given. One that runs
    dry leaves the windows to the others.

    A null or empty text is the end id alone. A null source is a source of its own. Repeated
    rows are packed each; a null doc_id is carried. Other columns are not read. An empty
    table gives an empty result. The same rows make the same windows.
    """
    path = path or byte_level_path()
    made = tokenised(docs, path, end_id).withColumn("row", F.monotonically_increasing_id())
    kept, _ = stored(made, "mix-tokens")
    narrow = kept.select("row", "source", "n", F.xxhash64(F.lit(seed), "doc_id").alias("tie"))
    pieces = schedule(narrow, weights, capacity, window, packet)
    pieces, path_of_pieces = stored(pieces, "mix-pieces")
    total = pieces.agg(F.sum("n").alias("t")).first()["t"] or 0
    stream = pieces.withColumn("all", F.lit(0))
    stream, _ = running_sums(stream, ["all"], ["window", "source", "at", "row"], "mix-stream")
    remove(docs.sparkSession, path_of_pieces)
    cut = _cut(stream, total, capacity)
    # A document's own pieces are gathered, never those of a source or a sequence.
    columns = ["start", "length", "sequence_id", "offset", "window"]
    by_row = cut.groupBy(F.col("row").alias("_r")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("pieces"))
    whole = kept.join(by_row.hint("merge"), F.col("row") == F.col("_r")).select("doc_id", "source", "n", "ids", "pieces")
    wide = max(byte_level(path).get_vocab_size(), end_id + 1) > 1 << 16

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype("<u4" if wide else "<u2")
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("pieces")
            at = lists.offsets.to_numpy()
            fields = lists.values.slice(at[0], at[-1] - at[0]).flatten()
            start, length, sequence_id, offset, number = [f.to_numpy() for f in fields]
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            crc, blobs, of = [], [], -1
            for r, a, n in zip(row.tolist(), start.tolist(), length.tolist()):
                if r != of:
                    of = r
                    own = np.frombuffer(batch.column("ids")[r].as_buffer(), kind).astype("<u4")
                data = own[a : a + n].tobytes()
                crc.append(zlib.crc32(data))
                if keep_ids:
                    blobs.append(data)
            taken = pa.array(row)
            columns = {
                "doc_id": batch.column("doc_id").take(taken),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": batch.column("n").take(taken),
                "sequence_id": pa.array(sequence_id),
                "offset": pa.array(offset),
                "source": batch.column("source").take(taken),
                "window": pa.array(number),
            }
            if keep_ids:
                columns["ids"] = pa.array(blobs, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, "
        "doc_tokens long, sequence_id long, offset long, source string, window long"
    )
    return whole.mapInArrow(digest, schema + (", ids binary" if keep_ids else ""))
