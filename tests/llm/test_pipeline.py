from collections import Counter

import pytest

import corpus_pipeline as P
from scriptloom.llm import components as C
from scriptloom.llm.common import stored
from scriptloom.llm.components import components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, tmp_path, prose, rows=None):
    if rows is None:
        rows = [(i, prose(i, 60 + i % 40), f"s{i % 4}") for i in range(120)]
        rows += [(200 + i, rows[i][1], "s0") for i in range(10)]  # exact copies
        rows += [(300 + i, rows[i][1] + " tail", "s1") for i in range(10, 20)]  # near copies
        rows += [(400 + i, "bad$$$ " * 40 + prose(900 + i, 5).replace(" ", "$$$ "), "s2") for i in range(60)]
    docs = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    labels = [(i, int("$$$" not in (t or "")), 0) for i, t, _ in rows]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_stages_take_effect(spark, tmp_path, prose):
    rows = corpus(spark, tmp_path, prose)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < len(P.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append(Counter(r["doc_id"] for r in docs.select("doc_id").collect()))
    good = {i for i, t, _ in rows if "$$$" not in t}
    assert set(left[0]) == good
    assert set(left[1]) == good - {200 + i for i in range(10)}
    assert set(left[2]) == set(left[1]) - {300 + i for i in range(10, 20)}
    assert set(left[3]) <= set(left[2]) and max(left[3].values()) <= 3
    assert sum(left[4].values()) >= sum(left[3].values())
    assert set(left[4]) == set(left[3])


CLASHING = [
    "k1", "k2", "k3", "_d", "_s", "_n", "_size", "_copies", "_copy", "score", "held_out", "predicted", "label", "size",
    "_doc", "_id", "_sha", "_source", "row", "class", "part", "rank", "keep_id", "kept", "target", "token", "a.b",
]


def test_edge_cases_and_clashing_names_go_through_all_stages(spark, tmp_path, prose):
    rows = [(i, prose(i, 40), f"s{i % 3}") for i in range(60)]
    rows += [(100, None, None), (101, "", "s0"), (102, " \t\n", None), (103, prose(7, 20_000), "s1"), (None, prose(8, 30), "s2")]
    rows += [rows[3], rows[3], (104, rows[4][1], "s0"), (200, "bad$$$ " * 40, "s2"), (201, "bad$$$ " * 50, "s2")]
    corpus(spark, tmp_path, prose, rows)
    plain = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = plain.selectExpr("*", *[f"concat('{c} ', doc_id) as `{c}`" for c in CLASHING])
    for k, (_, stage) in enumerate(P.STAGES):
        before = stage(spark, plain, str(tmp_path))
        if k < len(P.STAGES) - 1:
            found = stage(spark, docs, str(tmp_path))
            assert found.columns == docs.columns
            for c in CLASHING:
                assert found.where(f"doc_id is not null and `{c}` <> concat('{c} ', doc_id)").isEmpty()
            narrow = found.select(*plain.columns)
            assert sorted(map(str, narrow.collect())) == sorted(map(str, before.collect()))
            docs, plain = stored(found, "edge")[0], stored(before, "edge")[0]
        else:
            assert {r["doc_id"] for r in before.collect()} == {r["doc_id"] for r in plain.collect()}
    assert not {200, 201, 104} & {r["doc_id"] for r in plain.collect()}
    assert {103, None} <= {r["doc_id"] for r in plain.collect()}


def test_run_on_an_empty_table(spark, tmp_path, prose):
    corpus(spark, tmp_path, prose, [])
    assert P.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_components_of_paths_stars_and_rings(spark, monkeypatch, limit):
    monkeypatch.setattr(C, "FINISH_LINKS", limit)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in components(frame).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200: 200, 201: 200, 202: 200}
    assert got == want
    assert components(frame.limit(0)).collect() == []
