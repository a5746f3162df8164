import itertools
import re

import numpy as np
import pytest

from scriptloom.llm import ngram_join as J


def brute(rows, words=5, percent=75):
    sets = {}
    for doc_id, text in rows:
        found = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        grams = {tuple(found[i : i + words]) for i in range(len(found) - words + 1)} or ({tuple(found)} if found else set())
        sets.setdefault(doc_id, []).append(grams)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(d, s) for d, many in sets.items() for s in many if s]
    for (a, x), (b, y) in itertools.combinations(flat, 2):
        if 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d)) for d, many in sets.items() for s in many)


def check(docs, rows):
    got = J.jaccard_classes(docs(rows, extra=True)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def edited(text, rng, times):
    words = text.split()
    for _ in range(times):
        words[rng.integers(len(words))] = f"new{rng.integers(10**6)}"
    return " ".join(words)


def test_classes_agree_with_brute_force(docs, prose):
    rng = np.random.default_rng(3)
    base = [prose(i, int(rng.integers(8, 120))) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base * 4):
        rows.append((100 + i, edited(t, rng, int(rng.integers(0, 6)))))
    shared = prose(99, 60)  # a passage that many otherwise different texts share
    rows += [(300 + i, f"{prose(400 + i, 12)} {shared}") for i in range(20)]
    # One large group of near copies, at distances on both sides of the limit.
    rows += [(500 + i, edited(shared, rng, i % 5)) for i in range(40)]
    rows += [(700, None), (701, ""), (702, " \t\n"), (703, "Two words"), (704, "two  WORDS"), (705, "É é"), (706, "é é")]
    check(docs, rows)


def test_windows_and_buckets_do_not_matter(docs, prose, monkeypatch):
    monkeypatch.setattr(J, "BUCKET_ENTRIES", 50)
    monkeypatch.setattr(J, "WINDOW", 100)
    monkeypatch.setattr(J, "FREQUENT", 2)
    rng = np.random.default_rng(5)
    text = prose(1, 80)
    rows = [(i, edited(text, rng, i % 4)) for i in range(30)] + [(50 + i, prose(i, 40)) for i in range(5)]
    check(docs, rows)


def test_repeated_rows_ids_and_long_texts(docs, prose):
    long = prose(8, 30_000)
    check(docs, [(5, long), (3, long), (3, long), (9, long + " more"), (7, prose(9, 20)), (7, prose(10, 20))])


def test_null_id_and_empty_table(docs, prose):
    text = prose(4, 30)
    got = J.jaccard_classes(docs([(None, text), (4, text), (None, prose(5, 30))])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("4", "4"), ("None", "4"), ("None", "None")]
    assert J.jaccard_classes(docs([])).collect() == []


def test_one_of_each_class_is_left(docs, prose):
    text = prose(4, 60)
    rows = [(8, text), (2, text + " x"), (3, prose(6, 60)), (None, "a"), (4, None)]
    assert sorted(str(r["doc_id"]) for r in J.near_duplicates_left(docs(rows)).collect()) == ["2", "3", "4", "None"]


@pytest.mark.parametrize("n", [1, 7, 100, 4001])
def test_filter_never_drops_a_similar_pair(n):
    """At the first n-gram that two similar sets share, the rounded bounds still hold."""
    for m in {n, -(-3 * n // 4), (3 * n + 3) // 4 + 1}:
        if not 0 < m <= n:
            continue
        shared = -(-75 * (n + m) // 175)
        i, j = n - shared, m - shared
        if i < 0 or j < 0:
            continue
        code = lambda k: float(np.floor(64 * np.log2(k)))
        for a, p, b, q in ((n, i, m, j), (m, j, n, i)):
            assert J._passes(code(a), p * J._POS // a, code(b), q * J._POS // b, 75)


def test_a_large_group_of_mixed_distances(docs, prose):
    """Three hundred near copies, of which many are too far from each other."""
    rng = np.random.default_rng(11)
    text = prose(2, 90)
    rows = [(i, edited(text, rng, i % 9)) for i in range(300)]
    rows += [(400 + i, edited(rows[i * 7][1], rng, 3)) for i in range(40)]
    check(docs, rows)


def test_sketches_never_drop_a_similar_pair(spark):
    rng = np.random.default_rng(12)
    rows = []
    for n in (1, 4, 40, 700, 5000):
        for _ in range(20):
            one = rng.integers(0, 2**63, n, dtype=np.uint64)
            kept = one[: rng.integers(0, n + 1)]
            two = np.concatenate([kept, rng.integers(0, 2**63, rng.integers(1, n // 2 + 2), dtype=np.uint64)])
            one, two = np.unique(one), np.unique(two)
            same = len(np.intersect1d(one, two))
            near = 100 * same >= 75 * (len(one) + len(two) - same)
            rows.append((bool(near), len(one), len(two), *J._sketch(one).tolist(), *J._sketch(two).tolist()))
    names = ["near", "n_a", "n_b", *[f"{c}_a" for c in J.SKETCH], *[f"{c}_b" for c in J.SKETCH]]
    got = spark.createDataFrame(rows, names).select("near", "n_a", J._too_different(75).alias("far")).collect()
    assert not any(r.near and r.far for r in got) and any(r.near for r in got)
    assert sum(r.far for r in got if not r.near and 4 < r.n_a < 5000) > 10


def test_marks_never_drop_a_similar_pair():
    """Whatever the sizes, and they do tell most others apart, long sets included."""
    rng = np.random.default_rng(13)
    far = told = 0
    for n in (0, 1, 4, 40, 700, 5000, 60_000):
        for _ in range(20):
            one = rng.integers(0, 2**63, n, dtype=np.uint64)
            kept = one[: rng.integers(0, n + 1)]
            two = np.concatenate([kept, rng.integers(0, 2**63, rng.integers(1, n // 2 + 2), dtype=np.uint64)])
            one, two = np.unique(one), np.unique(two)
            same = len(np.intersect1d(one, two))
            passed = J._may_link(len(one), len(two), J._marks(one), J._marks(two), 75)
            if 100 * same >= 75 * (len(one) + len(two) - same):
                assert passed
            elif 2 * same < len(one) + len(two) - same and n > 4:
                far, told = far + 1, told + (not passed)
    assert far > 20 and told >= 0.9 * far


def test_marks_at_the_very_limit():
    """Three of four n-grams shared is a link; one fewer is none, though marks may let it pass."""
    tokens = np.random.default_rng(14).integers(0, 2**63, 400, dtype=np.uint64)
    assert J._may_link(300, 400, J._marks(tokens[:300]), J._marks(tokens), 75)
    assert J._may_link(350, 350, J._marks(tokens[:350]), J._marks(tokens[50:]), 75)


def test_candidates_do_not_grow_with_the_square_of_a_group(docs, prose, monkeypatch):
    """A large class, and rows that link with a tenth of it, so that a few pivots miss them."""
    rng = np.random.default_rng(15)
    text = prose(2, 90)
    rows = [(i, edited(text, rng, 1)) for i in range(400)] + [(400 + i, edited(text, rng, 2)) for i in range(200)]
    made, stored = [], J.stored

    def counted(frame, label):
        out = stored(frame, label)
        if label == "ngram-pairs":
            made.append(out[0].count())
        return out

    monkeypatch.setattr(J, "stored", counted)
    check(docs, rows)
    assert sum(made) < 10 * len(rows), made


def test_the_likeliest_of_another_class_is_met_once_a_row(spark, monkeypatch):
    """One pair for each row at most, also where a group is dealt out in parts."""
    monkeypatch.setattr(J, "GROUP", 16)
    rng = np.random.default_rng(16)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.95], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for _ in range(100)]
    known = spark.createDataFrame(
        [(i, len(s), *J._sketch(s).tolist()) for i, s in enumerate(sets)], ["row", "n", *J.SKETCH]
    )
    placed = spark.createDataFrame(
        [(t, i, i if i < 50 else 50, 0, 0) for i in range(100) for t in (7, 8 + i % 2)], ["token", "row", "class", "code", "pos"]
    )
    pairs = [tuple(r) for r in J._nearest(placed, known, 75).collect()]
    assert 30 < len(pairs) <= 100 and len(set(pairs)) == len(pairs)
    assert all(a > b and min(a, 50) != min(b, 50) for a, b in pairs)


def test_span_hashes_take_little_memory_and_do_not_depend_on_blocks(monkeypatch):
    import tracemalloc

    from scriptloom.llm import words as W

    raw = np.frombuffer(b"some words of a text \xc3\xa9 " * 160_000, np.uint8)
    starts, ends, _ = W.word_spans(raw, np.array([0, len(raw)]))
    tracemalloc.start()
    got = W.span_hashes(raw, starts, ends, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    monkeypatch.setattr(W, "BLOCK_BYTES", 1 << 12)
    assert np.array_equal(got, W.span_hashes(raw, starts, ends, True))


def test_sets_of_unlike_sizes_are_no_candidates(spark):
    """However many of its bits a large set fills, it shares too little with a small one."""
    rng = np.random.default_rng(18)
    small, large = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (300, 7000))
    assert not J._may_link(300, 7000, J._marks(small), J._marks(large), 75)
    assert J._may_link(75, 100, J._marks(large[:75]), J._marks(large[:100]), 75)
    assert not J._may_link(74, 100, J._marks(large[:74]), J._marks(large[:100]), 75)
    rows = [(len(a), len(b), *J._sketch(a).tolist(), *J._sketch(b).tolist()) for a, b in (
        (small, large), (large[:75], large[:100]), (large[:74], large[:100]), (large[:5250], large),
    )]
    names = ["n_a", "n_b", *[f"{c}_a" for c in J.SKETCH], *[f"{c}_b" for c in J.SKETCH]]
    got = spark.createDataFrame(rows, names).select(J._too_different(75).alias("far")).collect()
    assert [r.far for r in got] == [True, False, True, False]


def test_a_large_set_is_not_the_likeliest_of_all_others(spark):
    """Sixty unrelated sets and the near copies of ten of them share an n-gram with a few very large ones."""
    rng = np.random.default_rng(19)
    sizes = [200] * 60 + [7000] * 4
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in sizes]
    sets += [np.concatenate([s[:190], rng.integers(0, 2**63, 10, dtype=np.uint64)]) for s in sets[:10]]
    known = spark.createDataFrame([(i, len(s), *J._sketch(s).tolist()) for i, s in enumerate(sets)], ["row", "n", *J.SKETCH])
    placed = spark.createDataFrame([(7, i, i, 0, 0) for i in range(len(sets))], ["token", "row", "class", "code", "pos"])
    pairs = {tuple(r) for r in J._nearest(placed, known, 75).collect()}
    assert {(64 + i, i) for i in range(10)} <= pairs
    assert all(min(sizes[a] if a < 64 else 200, sizes[b]) * 4 >= 3 * max(sizes[a] if a < 64 else 200, sizes[b]) for a, b in pairs)
    assert len(pairs) <= 10 + 4
