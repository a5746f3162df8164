"""Words and shingles of whole batches of texts, as hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together inside a task.
CHUNK_BYTES = 4 << 20
#: Bytes whose spans are hashed together: eight bytes a byte, several times over.
BLOCK_BYTES = 1 << 18

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, with and without A-Z taken for a-z."""
    numbers = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    folded = numbers.copy()
    folded[65:91] = numbers[97:123]
    return numbers, folded


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(_P), -1, 2**64))
    out = []
    for base in (_P, inverse):
        a = np.full(n, base, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row starts and ends."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = at.astype(np.int64)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of at most so many bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, words being runs without blanks inside a row."""
    inside = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.empty(len(raw), bool)
    after = np.empty(len(raw), bool)
    if len(raw):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes of byte spans, in blocks of bounded size. Spans must be in order."""
    numbers = _tables()[fold]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, "right")))
        high = int(ends[j - 1])
        span = high - low
        up, down = _powers(max(BLOCK_BYTES, 1 << (span - 1).bit_length()) + 1)
        sums = np.empty(span + 1, np.uint64)
        sums[0] = 0
        np.cumsum(numbers[raw[low:high]] * up[:span], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mixed(out)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """For each row, the ascending hashes of its distinct runs of `words` words.

    A-Z count as a-z. A row with fewer words has its whole sequence as its only shingle,
    one without words has none. Two different shingles of a pair of documents get the
    same hash with a chance of about one in 10**13 for a thousand words each.
    """
    raw, at = text_bytes(column)
    starts, ends, row = word_spans(raw, at)
    hashes = span_hashes(raw, starts, ends, True)
    bounds = np.searchsorted(row, np.arange(len(at)), "left")
    factors = mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(hashes) - words + 1
    if n > 0:
        grams = np.zeros(n, np.uint64)
        for k in range(words):
            grams += hashes[k : k + n] * factors[k]
        grams = mixed(grams)
    out = []
    for r in range(len(at) - 1):
        a, b = int(bounds[r]), int(bounds[r + 1])
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                whole = (hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
