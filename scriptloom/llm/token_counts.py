"""Token counts under a unigram vocabulary, by dynamic programming shared in a trie.

The distinct words of a batch of texts are inserted into a trie, level by level. The best
unigram score of a prefix is the best, over its last pieces, of the score before the piece
plus the piece's; so it is worked out once for each node, however many words share it. The
node a word ends at keeps how many pieces its best segmentation has, and documents add up
the counts of their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.words import chunks, span_hashes, text_bytes, word_spans

#: Stands before each word, as in the vocabulary file.
MARK = "▁"
#: Words longer than this are worked out alone: they share no long prefixes.
LONGEST = 256
_BASE = 0x100000001B3
_WRAP = (1 << 64) - 1


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def zipf_scores(path: str) -> dict[str, float]:
    """Log probabilities for the pieces of a file, falling with their rank as 1 / rank.

    The file's own numbers only order the pieces. Control, byte and unknown pieces are left
    out: a character that no piece covers costs UNKNOWN and counts as one token.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    ]
    total = math.log(sum(1 / (k + 1) for k in range(len(pieces))))
    return {p: -math.log(k + 1) - total for k, p in enumerate(pieces)}


UNKNOWN = -30.0


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * _BASE + ord(c) + 1) & _WRAP
    return h


class Vocabulary:
    """Scores of pieces, and the same by rolling hash for whole levels of a trie."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        by_hash = {_hash(p): s for p, s in scores.items()}
        self.hashes = np.array(sorted(by_hash), np.uint64)
        self.values = np.array([by_hash[int(h)] for h in self.hashes])
        self.lengths = sorted({len(p) for p in scores} | {1})

    def lookup(self, hashes: np.ndarray, single: bool) -> np.ndarray:
        """Scores; minus infinity for what is no piece, UNKNOWN for a single character."""
        none = UNKNOWN if single else -np.inf
        if not len(self.hashes):
            return np.full(len(hashes), none)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at], none)


@cache
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(zipf_scores(path))


def count_alone(word: str, vocabulary: Vocabulary) -> int:
    """Pieces in the best segmentation of one word; of equal scores the shortest last piece wins."""
    best, pieces = [0.0], [0]
    for end in range(1, len(word) + 1):
        top, count = -math.inf, 0
        for n in vocabulary.lengths:
            if n > end:
                break
            s = vocabulary.scores.get(word[end - n : end], UNKNOWN if n == 1 else -math.inf)
            if (value := best[end - n] + s) > top:
                top, count = value, pieces[end - n] + 1
        best.append(top), pieces.append(count)
    return pieces[-1]


def count_pieces(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """Pieces of each of the words (with their mark), through one trie over them."""
    counts = np.zeros(len(words), np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    for i in np.flatnonzero(sizes > LONGEST):
        counts[i] = count_alone(words[i], vocabulary)
    short = np.flatnonzero((sizes <= LONGEST) & (sizes > 0))
    if not len(short):
        return counts
    points = np.frombuffer("".join(words[i] for i in short).encode("utf-32-le"), "<u4").astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes[short])[:-1]])
    # The root, then for each level: where its nodes' parents are, rolling hash, score, pieces.
    alive, node = np.arange(len(short)), np.zeros(len(short), np.int64)
    parents: list[np.ndarray] = [np.zeros(1, np.int64)]
    hashes: list[np.ndarray] = [np.zeros(1, np.uint64)]
    best: list[np.ndarray] = [np.zeros(1)]
    pieces: list[np.ndarray] = [np.zeros(1, np.int64)]
    powers = [pow(_BASE, k, 1 << 64) for k in range(vocabulary.longest + 1)]
    level = 0
    while len(alive):
        key, inverse = np.unique(node * 0x110000 + points[begin[alive] + level], return_inverse=True)
        level += 1
        parent = key // 0x110000
        parents.append(parent)
        hashes.append(hashes[-1][parent] * np.uint64(_BASE) + (key % 0x110000 + 1).astype(np.uint64))
        top, count = np.full(len(key), -np.inf), np.zeros(len(key), np.int64)
        ancestor, up = np.arange(len(key)), 0
        for n in vocabulary.lengths:
            if n > level:
                break
            while up < n:
                ancestor, up = parents[level - up][ancestor], up + 1
            piece = hashes[level] - hashes[level - n][ancestor] * np.uint64(powers[n])
            value = best[level - n][ancestor] + vocabulary.lookup(piece, n == 1)
            better = value > top
            top = np.where(better, value, top)
            count = np.where(better, pieces[level - n][ancestor] + 1, count)
        best.append(top), pieces.append(count)
        ends = sizes[short[alive]] == level
        counts[short[alive[ends]]] = count[inverse[ends]]
        alive, node = alive[~ends], inverse[~ends]
    return counts


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The rows with `n_words` and `n_tokens` (long) of their texts.

    Words are runs without `[\\x20\\x09-\\x0D]`; each counts with its mark before it. Null,
    empty and blank texts have no words and no tokens. Repeated rows count each, other
    columns are carried (columns with the two names are replaced), an empty table stays empty.
    """
    path = path or vocabulary_path()
    names = [c for c in docs.columns if c not in ("n_words", "n_tokens")]
    zero = F.lit(0).cast("long")
    schema = docs.select(*names).withColumns({"n_words": zero, "n_tokens": zero}).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        for batch in chunks(batches, "text"):
            raw, at = text_bytes(batch.column("text"))
            starts, ends, row = word_spans(raw, at)
            _, first, inverse = np.unique(span_hashes(raw, starts, ends, False), return_index=True, return_inverse=True)
            data = raw.tobytes()
            words = [
                MARK + data[s:e].decode("utf-8", "replace") for s, e in zip(starts[first].tolist(), ends[first].tolist())
            ]
            own = count_pieces(words, vocabulary)[inverse] if words else np.zeros(0, np.int64)
            tokens = np.bincount(row, own, batch.num_rows).astype(np.int64)
            n_words = np.bincount(row, minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(n_words), pa.array(tokens)], [*names, "n_words", "n_tokens"]
            )

    return docs.select(*names).mapInArrow(count, schema)
