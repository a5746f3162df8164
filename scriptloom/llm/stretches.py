"""Token ids of whole batches of texts, each distinct stretch of text tokenised once.

A tokeniser of either kind here treats some stretches of a text apart from what surrounds
them. Stretches repeat, within a chunk of texts and from chunk to chunk, so a process keeps
a table of those it has met with their ids. Bytes decide whether a stretch is in the table:
its hash only says where to look. The table starts afresh when it holds `MOST_BYTES` of text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa

from scriptloom.llm import words
from scriptloom.llm.words import text_bytes

#: Bytes of text that a table holds at most, but for the chunk it is working on.
MOST_BYTES = 16 << 20
#: Bytes of distinct stretches that are tokenised in a row.
GROUP_BYTES = 1 << 16

#: Tokenises spans of bytes: ids end to end, their number and whether they spell the bytes, by span.
Encode = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def joined(lengths: np.ndarray) -> np.ndarray:
    """Where each of some runs starts when they lie end to end, and where the last one ends."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of `data` end to end."""
    ups = joined(lengths)
    return data[np.repeat(begins - ups[:-1], lengths) + np.arange(ups[-1])]


class StretchTable:
    """Ids of stretches of text by their bytes."""

    def __init__(self, encode: Encode, most_bytes: int = MOST_BYTES):
        self.encode, self.most_bytes = encode, most_bytes
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.text = np.zeros(0, np.uint8)
        self.text_at = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.flat_at = np.zeros(1, np.int64)
        self.spelt = np.zeros(0, bool)

    def _append(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokenises spans and adds them at the end; returns their rows."""
        first = len(self.spelt)
        flat, counts, spelt = self.encode(raw, starts, ends)
        self.text = np.concatenate([self.text, gather(raw, starts, ends - starts)])
        self.text_at = np.concatenate([self.text_at, self.text_at[-1] + joined(ends - starts)[1:]])
        self.flat = np.concatenate([self.flat, flat])
        self.flat_at = np.concatenate([self.flat_at, self.flat_at[-1] + joined(counts)[1:]])
        self.spelt = np.concatenate([self.spelt, spelt])
        return np.arange(first, len(self.spelt))

    def _same_bytes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
        same = self.text_at[rows + 1] - self.text_at[rows] == ends - starts
        if not same.all():
            kept = np.flatnonzero(same)
            same[kept] = self._same_bytes(raw, starts[kept], ends[kept], rows[kept])
            return same
        lengths = ends - starts
        # The stretches of a chunk lie end to end, so their bytes need no gathering.
        own = raw[starts[0] : ends[-1]] if lengths.sum() == ends[-1] - starts[0] else gather(raw, starts, lengths)
        other = gather(self.text, self.text_at[rows], lengths) != own
        if other.any():
            same = np.add.reduceat(other, joined(lengths)[:-1], dtype=np.int64) == 0
        return same

    def look_up(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each stretch in `flat_at` and `spelt`. Stretches have at least one byte."""
        if self.text_at[-1] > self.most_bytes:
            self._clear()
        if not len(starts):
            return np.zeros(0, np.int64)
        codes, distinct = pd.factorize(words.span_hashes(raw, starts, ends, False))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            new = new[np.argsort(distinct[new])]
            rows = self._append(raw, starts[first[new]], ends[first[new]])
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            self.rows = np.insert(self.rows, at[new], rows)
            at = np.searchsorted(self.hashes, distinct)
        found = self.rows[at][codes]
        other = np.flatnonzero(~self._same_bytes(raw, starts, ends, found))
        if len(other):  # equal hashes of different bytes
            found[other] = self._append(raw, starts[other], ends[other])
        return found


# --- the byte-level vocabulary --------------------------------------------------------


def byte_level_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def byte_level(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


@cache
def byte_level_lengths(path: str) -> np.ndarray:
    """Bytes of each token; a byte-level token has a character for each."""
    made = byte_level(path)
    return np.array([len(made.id_to_token(i) or "") for i in range(made.get_vocab_size())], np.int64)


def _letters(raw: np.ndarray) -> np.ndarray:
    """Bytes that end an ASCII letter or a letter of the block that starts with 0xC3."""
    low = raw | 0x20
    plain = (low >= 0x61) & (low <= 0x7A)
    after_c3 = np.zeros(len(raw), bool)
    if len(raw):
        # 0xC3 0x97 and 0xC3 0xB7 are signs.
        after_c3[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] < 0xC0) & (raw[1:] & 0xDF != 0x97)
    return plain | after_c3


def byte_level_breaks(raw: np.ndarray) -> np.ndarray:
    """Places where the pre-tokeniser surely splits, whatever else the text holds.

    Before a single blank with visible ASCII or a letter of the 0xC3 block on either side,
    which begins the next pre-token, and between such a letter and a mark that stands before
    a blank or a line end.
    """
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    letters = _letters(raw)
    visible = (raw > 0x20) & (raw < 0x7F)
    blank = raw == 0x20
    out = np.zeros(len(raw), bool)
    # 0xC3 begins a letter unless it is one of the two signs, which start a pre-token as well.
    out[1:-1] = blank[1:-1] & (visible[:-2] | letters[:-2]) & (visible[2:] | (raw[2:] == 0xC3))
    mark = (raw == 0x2C) | (raw == 0x2E) | (raw == 0x3A) | (raw == 0x3B) | (raw == 0x21) | (raw == 0x3F)
    out[1:] |= mark[1:] & letters[:-1]
    return np.flatnonzero(out)


def byte_level_encode(path: str) -> Encode:
    """Spans that begin with a blank at a break are tokenised many in a row, the others one by one."""

    def encode(raw, starts, ends):
        data, letters = raw.tobytes(), _letters(raw)
        after = raw[np.minimum(starts + 1, len(raw) - 1)]
        begins = (raw[starts] == 0x20) & (ends - starts > 1) & (((after > 0x20) & (after < 0x7F)) | (after == 0xC3))
        last = raw[ends - 1]
        inside = begins & (((last > 0x20) & (last < 0x7F)) | (letters[ends - 1] & (ends - starts > 2)))
        order = np.concatenate([np.flatnonzero(inside), np.flatnonzero(~inside)])
        n = int(inside.sum())
        ups = joined((ends - starts)[order])
        text = gather(raw, starts[order[:n]], (ends - starts)[order[:n]]).tobytes()
        cuts = np.unique(np.append(np.searchsorted(ups[: n + 1], np.arange(0, ups[n], GROUP_BYTES)), n))
        spans = [(text, int(ups[a]), int(ups[b])) for a, b in zip(cuts, cuts[1:])]
        spans += [(data, s, e) for s, e in zip(starts[order[n:]].tolist(), ends[order[n:]].tolist())]
        made = byte_level(path).encode_batch_fast(
            [t[a:b].decode("utf-8", "replace") for t, a, b in spans], add_special_tokens=False
        )
        counts = np.empty(len(starts), np.int64)
        flat = np.concatenate([np.array(m.ids, np.uint32) for m in made] or [np.zeros(0, np.uint32)])
        spelt = np.zeros(len(starts), bool)
        sizes = byte_level_lengths(path)
        at = joined(np.array([len(m.ids) for m in made], np.int64))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            bounds = joined(sizes[flat[at[k] : at[k + 1]]])
            inner = np.searchsorted(bounds, ups[a : b + 1] - ups[a])
            inner = np.minimum(inner, len(bounds) - 1)
            if not np.array_equal(bounds[inner], ups[a : b + 1] - ups[a]):
                # Never seen: tokens of several spans in one. Then each span by itself.
                return _one_by_one(raw, starts, ends, path)
            counts[order[a:b]] = np.diff(inner)
            spelt[order[a:b]] = True
        alone = order[n:]
        counts[alone] = np.diff(at)[len(cuts) - 1 :]
        spelt[alone] = _spells(sizes, flat, at[len(cuts) - 1 :], (ends - starts)[alone], made[len(cuts) - 1 :], spans[len(cuts) - 1 :])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        begin = joined(counts[order])[:-1][back]
        return gather(flat, begin, counts), counts, spelt

    return encode


def _spells(sizes, flat, at, lengths, made, spans) -> np.ndarray:
    # A byte-level token spells the bytes it was made of; only a text that could not be read
    # as UTF-8 has other bytes.
    long = np.array([sizes[flat[a:b]].sum() for a, b in zip(at, at[1:])], np.int64) == lengths
    return long & np.array([b"\xef\xbf\xbd" in t[a:b] or "�" not in t[a:b].decode("utf-8", "replace") for t, a, b in spans], bool)


def _one_by_one(raw, starts, ends, path):
    data, sizes = raw.tobytes(), byte_level_lengths(path)
    spans = [(data, s, e) for s, e in zip(starts.tolist(), ends.tolist())]
    made = byte_level(path).encode_batch_fast(
        [t[a:b].decode("utf-8", "replace") for t, a, b in spans], add_special_tokens=False
    )
    flat = np.concatenate([np.array(m.ids, np.uint32) for m in made] or [np.zeros(0, np.uint32)])
    at = joined(np.array([len(m.ids) for m in made], np.int64))
    return flat, np.diff(at), _spells(sizes, flat, at, ends - starts, made, spans)


@cache
def byte_level_table(path: str) -> StretchTable:
    return StretchTable(byte_level_encode(path))


# --- the piece vocabulary -------------------------------------------------------------


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def piece_bytes(path: str) -> list[bytes]:
    """What each piece spells: U+2581 is a space, <0xHH> a byte."""
    made = pieces(path)
    out = []
    for i in range(made.get_piece_size()):
        piece = made.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if made.is_byte(i) else piece.replace("▁", " ").encode())
    return out


@cache
def piece_lengths(path: str) -> np.ndarray:
    return np.array([len(b) for b in piece_bytes(path)], np.int64)


@cache
def _splits_at_blanks(path: str) -> bool:
    """Whether no piece goes on with a space after something else, so that none spans two words."""
    made = pieces(path)
    return not any("▁" in made.id_to_piece(i).lstrip("▁") for i in range(made.get_piece_size()))


def piece_breaks(raw: np.ndarray, path: str) -> np.ndarray:
    """Places of blanks after something else: merges never reach across them."""
    if len(raw) < 2 or not _splits_at_blanks(path):
        return np.zeros(0, np.int64)
    return np.flatnonzero((raw[1:] == 0x20) & (raw[:-1] != 0x20)) + 1


def piece_encode(path: str) -> Encode:
    """Spans start with the blank that the model puts before a text."""

    def encode(raw, starts, ends):
        data, spell, made = raw.tobytes(), piece_bytes(path), pieces(path)
        spans = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        ids = made.encode([s[1:].decode("utf-8", "replace") for s in spans], num_threads=1)
        alone = made.piece_to_id("▁")
        # The model has no pieces for an empty text, but a blank at the end of one has its own.
        ids = [[alone] if s == b" " else i for s, i in zip(spans, ids)]
        spelt = np.array([b"".join([spell[k] for k in i]) == s for s, i in zip(spans, ids)], bool)
        counts = np.array([len(i) for i in ids], np.int64)
        flat = np.fromiter((k for i in ids for k in i), np.uint32, int(counts.sum()))
        return flat, counts, spelt

    return encode


@cache
def piece_table(path: str) -> StretchTable:
    return StretchTable(piece_encode(path))


# --- whole batches --------------------------------------------------------------------


def _batch(raw: np.ndarray, at: np.ndarray, breaks: np.ndarray, table: StretchTable):
    """Ids of rows end to end, where each row's start, and whether they spell the row."""
    begins = np.zeros(len(raw) + 1, bool)
    begins[breaks] = True
    begins[at] = True
    begins[-1] = False
    starts = np.flatnonzero(begins)
    rows = table.look_up(raw, starts, np.append(starts[1:], len(raw))[: len(starts)])
    counts = table.flat_at[rows + 1] - table.flat_at[rows]
    first = joined(begins)[at]
    wrong = joined(~table.spelt[rows])
    ids = gather(table.flat, table.flat_at[rows], counts)
    return ids, joined(counts)[first], wrong[first[1:]] == wrong[first[:-1]]


def byte_level_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of all texts end to end, where each text starts and ends, and whether its
    tokens spell it. The ids are those of whole texts."""
    raw, at = text_bytes(column)
    return _batch(raw, at, byte_level_breaks(raw), byte_level_table(path))


def piece_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `byte_level_ids`, for texts that have the model's blank before them already."""
    raw, at = text_bytes(column)
    return _batch(raw, at, piece_breaks(raw, path), piece_table(path))
