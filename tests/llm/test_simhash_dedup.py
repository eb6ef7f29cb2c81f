import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from pathloom.llm import simhash_dedup as S
from pathloom.llm.components import components


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    n = max(1, len(words) - 3)
    shingles = [" ".join(words[i : i + 4]) for i in range(n)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > n)


def brute_components(prints, ids, radius):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "A", "b\x0b"]
    out = ["", None, "one", "One", "a b c", "a b c d", " \t\n", "x\x1cy z"]
    for _ in range(20):
        base = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append("  ".join(copy))
    return out + [out[10]] * 3


def test_fingerprint_matches_definition():
    for t in texts():
        assert S.fingerprint(t or "") == brute_print(t)


def test_components_match_brute_force(spark):
    ts = texts()
    ids = [None if i == 12 else (i * 7) % 101 for i in range(len(ts))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, ts)], "doc_id long, text string, fp string, component_id int")
    got = sorted(((r.doc_id is None, r.doc_id), r.fp % 2**64, r.component_id) for r in S.simhash_components(df).collect())
    prints = [brute_print(t) for t in ts]
    want = sorted(((i is None, i), p, c) for i, p, c in zip(ids, prints, brute_components(prints, ids, 4)))
    assert [g[:2] for g in got] == [w[:2] for w in want] and got == want


@pytest.mark.parametrize("size", [16_384, 40])
def test_links_of_crowded_lists(spark, monkeypatch, size):
    """Many fingerprints that share bytes, with lists cut into slices too."""
    monkeypatch.setattr(S, "SLICE", size)
    monkeypatch.setattr(S, "SIDE", 32)
    rng = np.random.default_rng(1)
    near = rng.integers(0, 1 << 32, 300, dtype=np.uint64) & np.uint64(0x0F0F00FF)
    fps = np.unique(np.concatenate([near, rng.integers(0, 1 << 63, 60, dtype=np.uint64), near ^ np.uint64(1 << 63)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = {r.node: r.root for r in components(S.near_links(df, 4)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    signed = [int(x) for x in fps.view(np.int64)]
    want = brute_components([x % 2**64 for x in signed], signed, 4)
    assert [found.get(x, x) for x in signed] == want


def test_keep_one(spark):
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(5, long), (2, long), (2, long), (7, "other text entirely here"), (None, long), (9, None)]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.collect()) == sorted([(False, 2, long), (False, 7, rows[3][1]), (False, 9, None), (True, None, long)])


def test_positions_leave_no_gap():
    rng = random.Random(2)
    for matches, chosen in ((6, 2), (8, 2), (7, 3)):
        sets = [set(s) for s in S._positions(32, matches, chosen)]
        for _ in range(500):
            shared = set(rng.sample(range(32), matches))
            assert any(s <= shared for s in sets)
    assert len(S._positions(8, 4, 3)) == 20
    for matches in range(1, 9):
        sets = [set(s) for s in S._positions(8, matches, min(3, max(1, matches - 1)))]
        assert all(any(s <= set(shared) for s in sets) for shared in itertools.combinations(range(8), matches))


def test_the_tally_rejects_pairs(spark, monkeypatch):
    """Fingerprints that share three bytes meet in a list, and are no candidates; those with four are compared."""
    base = 0x1122334455667788
    three, four, near = base ^ 0x0101010101 << 24, base ^ 0xFFFFFFFF << 32, base ^ 0x02020202 << 32
    seen = []
    tally = S._tally
    fps = np.array([base, three, four, near], dtype=np.uint64)
    for radius, want in ((32, {(0, 2), (0, 3), (2, 3)}), (4, {(0, 3)})):
        i, j = tally(fps[:, None], fps[:, None], 4, radius)
        assert {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b} == want
    rng = np.random.default_rng(7)
    crowd = rng.integers(0, 1 << 40, 400, dtype=np.uint64) | np.uint64(0xABCDEF) << np.uint64(40)  # all share three bytes
    monkeypatch.setattr(S, "_tally", lambda a, b, *more: seen.append((len(a) * len(b), len(tally(a, b, *more)[0]))) or tally(a, b, *more))
    list(S._join_runs(np.arange(400), crowd[:, None], np.array([0]), np.array([400]), 4, 64))
    assert sum(n for n, _ in seen) == 400 * 400 and sum(kept for _, kept in seen) < 400 * 20


def test_repeated_ids(spark):
    """Against brute force: ids with several texts, exact and near copies under one id and under several."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [[word() for _ in range(200)] for _ in range(12)]

    def near(k):
        copy = list(base[k])
        copy[rng.randrange(200)] = word()
        return " ".join(copy)

    rows = [(2, " ".join(base[0])), (5, near(0)), (5, " ".join(base[1])), (5, " ".join(base[0])), (5, " ".join(base[0])), (6, ""), (6, None), (6, " ".join(base[2])), (6, near(2))]
    for _ in range(60):
        k = rng.randrange(3, 12)
        rows.append((rng.randrange(10, 22), near(k) if rng.random() < 0.5 else " ".join(base[k])))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, d0 string, node int").repartition(3)
    got = S.keep_one(df)
    assert got.columns == df.columns
    got = [(r.doc_id, r.text or "") for r in got.collect()]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(rows[i][1] or "", rows[j][1] or "") >= 0.8:
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(root(i), []).append((d, t or ""))
    assert len(got) == len(groups)
    for members in groups.values():
        least = min(d for d, _ in members)
        assert sum((d, t) in members and d == least for d, t in got) == 1


def test_components_of_hubs(spark, monkeypatch):
    """A node with many links, joined by broadcast, beside a long chain."""
    links = [(0, i) for i in range(1, 3000)] + [(10_000 + i, 10_001 + i) for i in range(500)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(3000)} | {10_000 + i: 10_000 for i in range(501)}


def test_first_bits_are_the_fingerprint():
    t = " ".join(f"w{i}" for i in range(50))
    assert int(S.wide_fingerprint(t, 4, 4)[0]) == S.fingerprint(t, 4)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(df).collect() == [] and S.keep_one(df).collect() == []


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def similarity(a, b):
    a, b = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("size", [2048, 5])
def test_only_similar_texts_go(spark, monkeypatch, size):
    """Copies around a similarity of 0.8, repeats that rule the fingerprint, and sets that repeats hide."""
    monkeypatch.setattr(S, "SLICE_OF_PAIRS", size)
    monkeypatch.setattr(S, "SIDE", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "61")
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(10):
        base = [rng.choice(words) for _ in range(rng.randint(150, 400))]
        for c in range(8):
            copy = list(base)
            for _ in range(c * len(base) // 150):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((rng.randrange(10**6), " ".join(copy)))
    for _ in range(12):  # one shingle makes up most of the text; the rest differs
        rows.append((rng.randrange(10**6), " ".join(["a"] * 200 + [rng.choice(words) for _ in range(60)])))
    tail = " ".join(rng.choice(words) for _ in range(60))
    rows += [(10**6 + 10, "b " * 300 + tail), (10**6 + 11, "b " * 5 + tail)]
    rows += [(10**6 + 1, ""), (10**6 + 2, None), (10**6 + 3, "three short words"), (10**6 + 4, "Three short  words")]
    texts = [t or "" for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    df = spark.createDataFrame([*rows, (None, texts[0])], "doc_id long, text string").repartition(3)
    try:
        got = [r.doc_id for r in S.keep_one(df).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert None in got and sorted(d for d in got if d is not None) == sorted(least.values())


def test_the_dedup_stage_verifies(spark):
    import corpus_pipeline as C

    rows = [(k, " ".join(["a"] * 200 + [f"w{k}x{i}" for i in range(60)])) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in C.near_dedup(spark, docs, "").collect()) == [0, 1, 2, 3]
