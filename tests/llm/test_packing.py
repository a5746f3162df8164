import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from scriptloom.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(P.tokenizer_path())
    made.encode_special_tokens = True
    return made


TEXTS = [
    "", " ", "  a", "a  b", "trailing ", "\n a b\t c d", "é è naïve çà", "<|endoftext|> x", "日本 語 text",
    "don't we'll 12 3.4", "a b c", "x y z", "emoji 😀 here", "A" * 5000, "word " * 3000,
]


def test_ids_are_those_of_whole_texts(tokenizer):
    import pyarrow as pa

    ids, at = P.batch_ids(pa.array([*TEXTS, None]), P.tokenizer_path())
    for k, text in enumerate([*TEXTS, ""]):
        assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_fill_sequences_without_gaps(docs, tokenizer, prose):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, prose(k, 30 + 37 * k)) for k in range(40)]
    rows += [(900, None), (None, "no id"), (3, "a  b")]
    got = P.pack_documents(docs(rows, extra=True), keep_ids=True).collect()
    texts = defaultdict(list)
    for r in got:
        texts[r["doc_id"]].append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for doc_id, text in rows:
        if doc_id == 3:
            assert len(texts[3]) == 2  # the row is there twice
            continue
        pieces = sorted(texts[doc_id], key=lambda r: r["piece"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces]).tolist()
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, P.END_ID]
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces[:-1]]).tolist()
        assert all(r["length"] == 1024 for r in pieces[1:])
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts[:-1]]).tolist()
        assert sum(n for _, n in parts) <= 1024
    least = -(-sum(r["length"] for r in got) // 1024)
    assert len(bins) <= least + 1


def test_fixed_number_of_bins_and_the_fullest_closes():
    bins = P.OpenBins(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(8) == (2, 0)  # bin 1 is fuller than bin 0 and closes
    assert bins.open() == {0: 6, 2: 8}
    assert bins.place(4) == (0, 6) and bins.place(2) == (2, 8)
    assert bins.open() == {}
    assert bins.place(10) == (3, 0) and bins.open() == {}


def test_rounds_with_few_bins(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1025, 3000).tolist()
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length long").repartition(7)
    got = P.best_fit(items, open_bins=16, window=32).collect()
    assert sorted(r["item"] for r in got) == list(range(3000))
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], sizes[r["item"]]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts[:-1]]).tolist()
        assert sum(n for _, n in parts) <= 1024
    assert len(bins) < 1.1 * sum(sizes) / 1024


def test_empty_table(docs):
    assert P.pack_documents(docs([])).collect() == []
