import numpy as np

from scriptloom.llm.embedding_dedup import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n int, node string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], SCHEMA)


def brute(rows, cosine=0.93):
    good = []
    for i, v, lab in rows:
        ok = lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, np.float32).astype(float) if ok else None)
    degree, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(len(rows)):
            x, y = good[a], good[b]
            if a == b or x is None or y is None or rows[a][2] != rows[b][2] or len(x) != len(y):
                continue
            if np.array_equal(x, y) or x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                degree[a] += 1
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    least = {}
    for a in range(len(rows)):
        least[find(a)] = min(least.get(find(a), rows[a][0]), rows[a][0])
    return sorted((rows[a][0], degree[a], least[find(a)]) for a in range(len(rows)))


def vectors(seed, n, width=64):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = rng.standard_normal(width)
        for _ in range(int(rng.integers(1, 6))):
            noise = rng.standard_normal(width) * rng.uniform(0, 0.5)
            rows.append((len(rows), [float(x) for x in np.float32(base + noise)], int(rng.integers(0, 2))))
    return rows


def check(spark, rows, **how):
    got = near_vectors(frame(spark, rows), **how).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_links_agree_with_brute_force(spark):
    rows = vectors(1, 60)
    rows += [(len(rows) + k, rows[k][1], rows[k][2]) for k in range(5)]  # equal vectors
    rows += [(900 + k, [3 * x for x in rows[k][1]], rows[k][2]) for k in range(5)]  # equal directions
    check(spark, rows)


def test_tiles_blocks_and_grids_do_not_matter(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal(10)
    rows = vectors(2, 20, width=10)
    rows += [(500 + k, [float(x) for x in np.float32(base + rng.standard_normal(10) * 0.1)], 7) for k in range(60)]
    check(spark, rows, tile=8, block=3, grid=2)
    check(spark, rows, tile=1000, block=4, grid=1)


def test_what_links_with_nothing(spark):
    v = [1.0] + [0.0] * 7
    rows = [
        (1, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [0.0] * 8, 1), (6, [None] + v[1:], 1), (7, [], 1),
        (8, [float("nan")] + v[1:], 1), (9, [float("inf")] + v[1:], 1), (10, v, 2), (11, v[:5], 1), (12, [-0.0 + x for x in v], 1),
    ]
    check(spark, rows)


def test_empty_table(spark):
    assert near_vectors(frame(spark, [])).collect() == []
