"""Cross-tokenizer alignment by pointer jumping.

The tokens of two tokenisers cover the same bytes. Every token points to the token of the
other side that overlaps it and reaches farthest to the right, or to itself where none
reaches farther; of two that end together the first side's points to the second's. Doubling
the pointers of a whole batch at once leads every token to the last one it is connected to
through overlaps, which labels its group. Groups are what lies between two places where both
sides end a token.

How often two ids end together over all documents is counted by task and then summed. One
of two such tokens spells the end of the other, so there are no more pairs than the two
vocabularies have common endings: a bound that is computed and checked before the counts
are sent to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import stored
from scriptloom.llm.stretches import (
    byte_level,
    byte_level_ids,
    byte_level_lengths,
    byte_level_path,
    gather,
    joined,
    piece_bytes,
    piece_ids,
    piece_lengths,
    piece_path,
)
from scriptloom.llm.words import chunks

#: Bytes of text, and tokens of a side in stored rows, that a task works on together.
CHUNK = 1 << 20
TOKENS = 1 << 18
#: Stored rows: ids as little-endian numbers, and for each a byte that is 1 at a group's end.
_STORED = ["a_ids", "b_ids", "a_last", "b_last"]


def overlap_groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers, from 0 and ascending, of two runs of tokens over the same bytes.

    Tokens are given by where they end, in ascending order from above 0; the last ones of
    both sides end together.
    """
    n_a, n_b = len(a_ends), len(b_ends)
    if not n_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marks = np.zeros((2, int(a_ends[-1]) + 1), bool)
    marks[0, a_ends] = True
    marks[1, b_ends] = True
    # The token of the other side that holds a token's last byte reaches farthest right.
    to_b = joined(marks[1])[a_ends]
    to_a = joined(marks[0])[b_ends]
    follow = np.empty(n_a + n_b, np.int64)
    follow[:n_a] = n_a + to_b
    follow[n_a:] = np.where(a_ends[to_a] > b_ends, to_a, n_a + np.arange(n_b))
    while True:
        further = follow[follow]
        if np.array_equal(further, follow):
            break
        follow = further
    last = np.zeros(n_b, bool)
    last[follow - n_a] = True  # every chain ends at a token of the second side
    number = np.cumsum(last) - 1
    return number[follow[:n_a] - n_a], number[follow[n_a:] - n_a]


def _kept(ids: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some rows end to end, and the number of all rows, zero for the others."""
    counts = np.where(rows, np.diff(at), 0)
    return gather(ids, at[:-1], counts), counts


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of numbers as a binary column."""
    offsets = (joined(counts) * values.itemsize).astype("<i4")
    return pa.Array.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]
    )


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The reverse: all numbers end to end, and where each row's start."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    values = np.frombuffer(data.slice(at[0], at[-1] - at[0]), kind) if at[-1] > at[0] else np.zeros(0, kind)
    return values, (at - at[0]) // size


def _id_kind(path: str, lengths) -> str:
    return "<u2" if len(lengths(path)) <= 1 << 16 else "<u4"


def _tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: doc_id and the columns of `_STORED`."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_sizes, b_sizes = byte_level_lengths(a_path), piece_lengths(b_path)
        a_kind, b_kind = _id_kind(a_path, byte_level_lengths), _id_kind(b_path, piece_lengths)
        for batch in chunks(batches, "text", CHUNK):
            a, a_at, a_spelt = byte_level_ids(batch.column("text"), a_path)
            b, b_at, b_spelt = piece_ids(batch.column("text"), b_path)
            rows = a_spelt & b_spelt
            a, n_a = _kept(a, a_at, rows)
            b, n_b = _kept(b, b_at, rows)
            # The ends of a row are the same on both sides, so no group spans two rows.
            in_a, in_b = overlap_groups(np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b]))
            a_last, b_last = (np.diff(g, append=-1) != 0 for g in (in_a, in_b))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    _binary(a.astype(a_kind), n_a),
                    _binary(b.astype(b_kind), n_b),
                    _binary(a_last.view(np.uint8), n_a),
                    _binary(b_last.view(np.uint8), n_b),
                ],
                ["doc_id", *_STORED],
            )

    text = F.when(F.col("text") != "", F.concat(F.lit(" "), F.col("text"))).otherwise("")
    schema = f"doc_id {kind}, " + ", ".join(f"{c} binary" for c in _STORED)
    return docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).mapInArrow(align, schema)


class _Aligned:
    """The stored columns of some rows as flat arrays, with where each row starts in them."""

    def __init__(self, batch: pa.RecordBatch, a_kind: str, b_kind: str):
        self.a, self.a_at = _numbers(batch.column("a_ids"), a_kind)
        self.b, self.b_at = _numbers(batch.column("b_ids"), b_kind)
        self.a_last, _ = _numbers(batch.column("a_last"), "u1")
        self.b_last, _ = _numbers(batch.column("b_last"), "u1")
        self.a_ends, self.b_ends = np.flatnonzero(self.a_last), np.flatnonzero(self.b_last)
        #: Where each row's groups start.
        self.at = joined(self.a_last)[self.a_at]

    def links(self) -> np.ndarray:
        """The two ids that end each group, as one number."""
        return self.a[self.a_ends].astype(np.int64) << 32 | self.b[self.b_ends].astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[tuple[pa.RecordBatch, _Aligned]]:
    """Rows of at most so many tokens of the second side, or one row."""
    a_kind, b_kind = _id_kind(a_path, byte_level_lengths), _id_kind(b_path, piece_lengths)
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = _numbers(batch.column("b_last"), "u1")
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + TOKENS, "right")) - 1)
            rows = batch.slice(first, last - first)
            yield rows, _Aligned(rows, a_kind, b_kind)
            first = last


def align_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per document (doc_id, text): both sides' ids and how groups share them out.

    `a_ids` are those of a blank and the text in a byte-level vocabulary, `b_ids` those of
    the text in a piece vocabulary that puts the blank there itself; `a_sizes` and `b_sizes`
    tell how many ids of each side every group holds, in order. Strings of special tokens in
    a text are plain text. A null or empty text, and one that either side's tokens do not
    spell, has empty lists. Rows that repeat count each; a null doc_id is carried; other
    columns are not read. An empty table gives an empty result.
    """
    a_path, b_path = a_path or byte_level_path(), b_path or piece_path()
    tokens = _tokens(docs, a_path, b_path)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def lists(values, counts):
        return pa.ListArray.from_arrays(pa.array(joined(counts).astype(np.int32)), pa.array(values.astype(np.int32)))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _slices(batches, a_path, b_path):
            n = np.diff(rows.at)
            columns = [
                batch.column("doc_id"),
                lists(rows.a, np.diff(rows.a_at)),
                lists(rows.b, np.diff(rows.b_at)),
                lists(np.diff(rows.a_ends, prepend=-1), n),
                lists(np.diff(rows.b_ends, prepend=-1), n),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"])

    schema = f"doc_id {kind}, " + ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_sizes", "b_sizes"))
    return tokens.mapInArrow(unpack, schema)


def _link_counts(tokens: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a, b, n): how many groups end with id `a` on one side and `b` on the other."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, rows in _slices(batches, a_path, b_path):
            new, more = np.unique(rows.links(), return_counts=True)
            keys, into = np.unique(np.concatenate([keys, new]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, into, np.concatenate([counts, more]))
            counts = total
        columns = [pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(counts)]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

    counted = tokens.select(*_STORED).mapInArrow(count, "a long, b long, n long")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))


@cache
def most_links(a_path: str, b_path: str) -> int:
    """How many pairs of ids can end together: those of which one spells the other's end."""
    made = byte_level(a_path)
    a = [_byte_level_bytes(made.id_to_token(i) or "") for i in range(made.get_vocab_size())]
    b = piece_bytes(b_path)

    def ends_of(longer: list[bytes], shorter: list[bytes], proper: int) -> int:
        seen: dict[bytes, int] = {}
        for s in shorter:
            seen[s] = seen.get(s, 0) + 1
        return sum(seen.get(t[k:], 0) for t in longer for k in range(proper, len(t)))

    return ends_of(a, b, 0) + ends_of(b, a, 1)


@cache
def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _byte_level_bytes(token: str) -> bytes:
    table = _byte_of()
    return bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()


@cache
def _digits(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal numbers below `most`, each followed by a comma: bytes, begins, lengths."""
    texts = [b"%d," % k for k in range(most)]
    lengths = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), joined(lengths)[:-1], lengths


def _group_texts(rows: _Aligned, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of `a1,a2|b1;a3|b2,b3;` for all rows, and where each row's start."""
    in_a, in_b = (joined(last)[:-1] for last in (rows.a_last, rows.b_last))
    a_upto, b_upto = rows.a_ends + 1, rows.b_ends + 1
    ids = np.empty(len(rows.a) + len(rows.b), np.int64)
    ids[np.arange(len(rows.a)) + np.append(0, b_upto)[in_a]] = rows.a
    ids[np.arange(len(rows.b)) + a_upto[in_b]] = rows.b
    text, begins, lengths = _digits(most)
    ends = joined(lengths[ids])
    out = gather(text, begins[ids], lengths[ids])
    group_ends = a_upto + b_upto
    out[ends[group_ends - np.diff(b_upto, prepend=0)] - 1] = ord("|")
    out[ends[group_ends] - 1] = ord(";")
    return out, ends[np.append(0, group_ends)[rows.at]]


def alignment_report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256.

    A link is a token of either side that end together, one for each group. `n_best` counts
    those whose pair of ids is the most frequent of all documents for its second id, ties
    included; `count_sum` adds up the frequencies of all. Documents without tokens have
    zeros and an empty text. Nulls, repeats and other columns are as in `align_tokens`.
    """
    a_path, b_path = a_path or byte_level_path(), b_path or piece_path()
    spark = docs.sparkSession
    tokens, _ = stored(_tokens(docs, a_path, b_path), "align-tokens")
    found = _link_counts(tokens, a_path, b_path).toArrow()
    bound = most_links(a_path, b_path)
    if found.num_rows > bound:
        raise ValueError(f"{found.num_rows} pairs of ids end together, more than the {bound} that can")
    keys = found.column("a").to_numpy() << 32 | found.column("b").to_numpy()
    order = np.argsort(keys)
    keys, counts = keys[order], found.column("n").to_numpy()[order]
    seconds, into = np.unique(keys & 0xFFFFFFFF, return_inverse=True)
    highest = np.zeros(len(seconds), np.int64)
    np.maximum.at(highest, into, counts)
    table = spark.sparkContext.broadcast((keys, counts, counts == highest[into]))
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = table.value
        most = max(len(byte_level_lengths(a_path)), len(piece_lengths(b_path)))
        for batch, rows in _slices(batches, a_path, b_path):
            at = np.searchsorted(known, rows.links())
            text, ends = _group_texts(rows, most)
            data = memoryview(text.tobytes())
            digests = [
                hashlib.sha256(data[a : b - 1]).hexdigest() if b > a else ""
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())
            ]
            n_groups = np.diff(rows.at)
            columns = [
                np.diff(rows.a_at),
                np.diff(rows.b_at),
                n_groups,
                n_groups,
                np.diff(joined(best[at])[rows.at]),
                np.diff(joined(n[at])[rows.at]),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c.astype(np.int64)) for c in columns], pa.array(digests, pa.string())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return tokens.mapInArrow(report, schema)
