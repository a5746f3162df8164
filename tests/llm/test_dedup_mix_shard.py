import hashlib
import re
import zlib
from collections import Counter, defaultdict

from scriptloom.llm import mixing as M
from scriptloom.llm import radix_dedup as R
from scriptloom.llm import sharding as S


def norm(text):
    return re.sub(r"[ \t-\r]", "", text or "")


def test_radix_dedup_agrees_with_grouping(docs, prose):
    long = prose(1, 4000)
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n\t"), (7, long), (8, long + "x"), (9, long + "y"), (10, long + " x")]
    rows += [(20 + i, prose(i % 3, 20)) for i in range(12)] + [(50, "a b"), (51, "ab" * 16), (52, "ab" * 17)]
    got = {r["doc_id"]: r for r in R.radix_dedup(docs(rows, extra=True)).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i))
    assert len(got) == len(rows)
    for i, t in rows:
        members, r = groups[norm(t)], got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(members)[1], len(members), min(members)[1] == i)
        assert r["text_sha256"] == hashlib.sha256(norm(t).encode()).hexdigest()
    assert sorted(r["doc_id"] for r in R.keep_first(docs(rows)).collect()) == sorted(min(m)[1] for m in groups.values())


def test_radix_dedup_of_repeats_null_ids_and_nothing(docs):
    got = R.radix_dedup(docs([(1, "x"), (1, "x"), (None, "x"), (None, "y")])).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["kept"]) for r in got) == [
        ("1", "1", False), ("1", "1", True), ("None", "1", False), ("None", "None", True),
    ]
    assert len(R.keep_first(docs([(1, "x"), (1, "x"), (None, "y")])).collect()) == 2
    assert R.radix_dedup(docs([])).collect() == []


def targets(sizes):
    """The stated rule, in plain Python: sources in order, null last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, left = {}, sum(sizes.values())
    free = set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix_meets_its_targets(docs, prose):
    rows = []
    for s, n in (("a", 60), ("b", 200), ("c", 5), (None, 30), ("é", 80), ("Z", 40)):
        rows += [(len(rows) + k, prose(k, 10 + k % 50), s) for k in range(n)]
    rows += [(9000, None, "a"), (9001, " \n", "b"), (None, "x y", "b"), (0, rows[0][1], rows[0][2])]
    frame = M.with_sizes(docs(rows, extra=True))
    got = M.mix(frame).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^ \t-\r]+", t or ""))
    want = targets(sizes)
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    again = M.mix(M.with_sizes(docs(rows).repartition(5))).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))
    copies = Counter(r["doc_id"] for r in M.take_copies(docs(rows)).collect())
    assert copies == Counter({r["doc_id"]: 0 for r in got}) + Counter(
        {i: n for i, n in Counter(x for r in got for x in [r["doc_id"]] * r["copies"]).items()}
    )
    assert M.mix(M.with_sizes(docs([]))).collect() == []


def test_several_margins_are_met_together(spark):
    cells = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 20.0), ("b", "x", 30.0), ("b", "y", 40.0)], "s string, l string, size double")
    s = spark.createDataFrame([("a", 50.0), ("b", 50.0)], "s string, target double")
    lang = spark.createDataFrame([("x", 30.0), ("y", 70.0)], "l string, target double")
    rows = M.entropy_balance(cells, {"s": s, "l": lang}).collect()
    for column, goals in (("s", {"a": 50, "b": 50}), ("l", {"x": 30, "y": 70})):
        for value, goal in goals.items():
            assert abs(sum(r["rate"] * r["size"] for r in rows if r[column] == value) - goal) < 1e-6


def test_shards_are_exact_and_gapless(docs, prose):
    rows = [(i, prose(i, 5)) for i in range(997)] + [(None, None), (5, prose(5, 5)), (2000, "é")]
    got = S.shard_documents(docs(rows, extra=True).repartition(6)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert S.shard_documents(docs([])).collect() == []


def test_hypergeometric_law(spark):
    from math import comb

    from pyspark.sql import functions as F

    n = 20_000
    draws = spark.range(n).select(
        S.hypergeometric(F.lit(20), F.lit(7), F.lit(6), (F.col("id") + 0.5) / n).alias("k")
    ).groupBy("k").count().collect()
    for r in draws:
        exact = comb(7, r["k"]) * comb(13, 6 - r["k"]) / comb(20, 6)
        assert abs(r["count"] / n - exact) < 2 / n + 1e-9
