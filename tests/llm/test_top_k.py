import numpy as np
import pytest

from pathloom.llm import top_k as K


def brute(rows, queries, k):
    out = []
    best_of = {}
    for q, qv in queries:
        for v, vv in rows:
            if v != q and len(vv) == len(qv):
                s = sum(int(a) * int(b) for a, b in zip(qv, vv))
                best_of[q, v] = max(s, best_of.get((q, v), s))
    for q in sorted({q for q, _ in queries}):
        ranked = sorted(((-s, v) for (x, v), s in best_of.items() if x == q))[:k]
        out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(ranked)]
    return out


@pytest.mark.parametrize(("n", "d", "spread", "block"), [(300, 8, 3, 64), (500, 16, 1000, 128), (40, 4, 1, 8192), (7, 3, 5, 2)])
def test_matches_brute_force(spark, monkeypatch, n, d, spread, block):
    monkeypatch.setattr(K, "BLOCK", block)
    rng = np.random.default_rng(n)
    rows = [(int(i) % (n - 3), [int(x) for x in rng.integers(-spread, spread + 1, d)]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, vec array<long>").repartition(3)
    got = [tuple(r) for r in K.fagin_top_k(df.where("id % 10 = 0"), df, 5).orderBy("query_id", "rank").collect()]
    assert got == brute(rows, [r for r in rows if r[0] % 10 == 0], 5)


def test_stops_early_where_the_bound_allows():
    rng = np.random.default_rng(0)
    vecs = rng.integers(-10, 11, (4000, 4)).astype(float)
    vecs[7] = [1000, 1000, 1000, 1000]
    block = K.Block(np.arange(4000), vecs)
    seen = []
    block.vecs = type("Watched", (np.ndarray,), {})  # any full product would fail on this
    block.vecs = vecs
    best = [(np.empty(0), np.empty(0, dtype=np.int64))]
    merge = K.Block._merge
    K.Block._merge = staticmethod(lambda j, s, i, *a: (seen.append(len(s)), merge(j, s, i, *a)))
    try:
        block.search(np.array([[1.0, 1, 1, 1]]), np.array([-1]), 1, best)
    finally:
        K.Block._merge = staticmethod(merge)
    assert best[0][1].tolist() == [7] and sum(seen) < 40


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(K, "QUERIES", 5)
    rows = [(i, [i % 7, (i * i) % 11]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<long>")
    got = sorted(tuple(r) for r in K.fagin_top_k(df.where("id % 3 = 0"), df, 4).collect())
    assert got == sorted(brute(rows, [r for r in rows if r[0] % 3 == 0], 4))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25], "x"), (1, None, "x"), (None, [1.0, 1.0], "x"), (2, [nan, 1.0], "x"), (3, [inf, 0.0], "x"), (4, [None, 0.0], "x"), (5, [0.5, 0.5], "x"), (6, [1.0], "x"), (7, [], "x"), (0, [0.5, -0.25], "x"), (8, [1e30, 1e30], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    v = K.integer_vectors(df)
    assert sorted(r.id for r in v.collect()) == [0, 0, 5, 6, 7, 8]
    got = {(r.query_id, r["rank"], r.vec_id) for r in K.fagin_top_k(v.where("id = 0"), v, 10).collect()}
    assert got == {(0, 1, 8), (0, 2, 5)}
    assert K.fagin_top_k(v.limit(0), v, 3).collect() == [] and K.fagin_top_k(v, v.limit(0), 3).collect() == []


def test_reads_on_to_the_depth_where_the_bound_falls(monkeypatch):
    vecs = np.random.default_rng(1).integers(-10, 11, (4000, 4)).astype(float)
    for j in range(4):  # long components of bad vectors lead each list
        vecs[60 * j : 60 * j + 60] = -100
        vecs[60 * j : 60 * j + 60, j] = 100
    vecs[999] = 50
    block, scored, best = K.Block(np.arange(4000), vecs), [], [(np.empty(0), np.empty(0, dtype=np.int64))]
    merge = K.Block._merge
    monkeypatch.setattr(K.Block, "_merge", staticmethod(lambda j, s, i, *a: (scored.append(len(s)), merge(j, s, i, *a))))
    block.search(np.array([[1.0, 1, 1, 1]]), np.array([-1]), 1, best)
    assert best[0][1].tolist() == [999] and sum(scored) < 1000
