import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from scriptloom.llm import mixture_packing as M
from scriptloom.llm import stretches as S


def whole_ids(text):
    return [*S.byte_level(S.byte_level_path()).encode(text or "", add_special_tokens=False).ids, M.END_ID]


def check_pieces(got, rows, capacity):
    """Every id once, sequences gapless, full or of a power of two."""
    texts = defaultdict(list)
    for r in got:
        texts[r["doc_id"]].append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
    assert set(texts) == {i for i, _, *_ in rows}
    for doc_id, text, *_ in rows:
        pieces = sorted(texts[doc_id], key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces]).tolist()
        assert ids == whole_ids(text) and {r["doc_tokens"] for r in pieces} == {len(ids)}
        assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces[:-1]]).tolist()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    fills = []
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts[:-1]]).tolist()
        fills.append(sum(n for _, n in parts))
    total = sum(fills)
    assert Counter(fills)[capacity] >= total // capacity
    assert all(f == capacity or f & (f - 1) == 0 for f in fills) and max(fills) <= capacity
    assert len(bins) <= total // capacity + capacity.bit_length()


def shares(got, windows):
    by = defaultdict(Counter)
    for r in got:
        by[r["window"]][r["source"]] += r["length"]
    return [by[w] for w in windows]


def test_pieces_and_windows(docs, prose):
    sizes = {"a": 60, "b": 15, None: 20}
    rows = [
        (f, prose(f, 20 + f % 90), s)
        for f, s in enumerate(s for s, n in sizes.items() for _ in range(n))
    ]
    rows += [(900, None, "a"), (901, "", "b"), (902, "word " * 4000, "b"), (None, "no id", "a")]
    got = M.pack_mixture(docs(rows, extra=True), window=2, packet=64, keep_ids=True).collect()
    check_pieces(got, rows, 1024)
    total, whole = sum(r["length"] for r in got), Counter()
    for r in got:
        whole[r["source"]] += r["length"]
    windows = range(total // 2048)
    assert len(windows) >= 5
    upto = Counter()
    for k, mixed in enumerate(shares(got, windows), 1):
        upto += mixed
        for s, n in whole.items():
            # What a queue is owed is less than a packet, however many windows went by.
            assert 0 <= k * 2048 * n / total - upto[s] < 64 + 1e-6


def test_given_weights_and_a_queue_that_runs_dry(docs, spark, prose):
    rows = [(k, prose(k, 60), "ab"[k % 2]) for k in range(80)]
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 9.0), ("a", 0.0)], "source string, weight double")
    got = M.pack_mixture(docs(rows), weights.where("source <> 'c'"), window=2, packet=32, keep_ids=True).collect()
    check_pieces(got, rows, 1024)
    mixed = shares(got, range(3))
    assert all(abs(m["a"] / (m["a"] + m["b"]) - 0.75) < 0.05 for m in mixed)
    last = max(r["window"] for r in got)
    assert shares(got, [last])[0]["a"] == 0


def test_the_same_windows_however_the_rows_lie(docs, prose):
    rows = [(k, prose(k, 30), "abc"[k % 3]) for k in range(60)]
    one = M.pack_mixture(docs(rows), window=2).collect()
    two = M.pack_mixture(docs(rows[::-1]).repartition(7), window=2).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_repeated_rows_and_small_capacity(docs):
    rows = [(1, "the same text", "s")] * 5 + [(2, "other", "t")]
    got = M.pack_mixture(docs(rows), capacity=4, window=1, packet=2).collect()
    n = len(whole_ids("the same text"))
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 5 * n
    assert {r["doc_tokens"] for r in got if r["doc_id"] == 1} == {n}


@pytest.mark.parametrize("sources", [1, 40])
def test_running_sums_of_batches(spark, sources):
    rng = np.random.default_rng(3)
    rows = [(int(k % sources), k, int(n)) for k, n in enumerate(rng.integers(1, 50, 500))]
    frame = spark.createDataFrame(rows, "g long, k long, n long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got, totals = M.running_sums(frame, ["g"], ["k"], "test-sums")
        got, totals = got.collect(), totals.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    upto = Counter()
    want = {}
    for g, k, n in rows:
        want[k] = upto[g]
        upto[g] += n
    assert {r["k"]: r["begin"] for r in got} == want
    assert {r["g"]: r["total"] for r in totals} == dict(upto)


def test_empty_table(docs):
    assert M.pack_mixture(docs([])).collect() == []
