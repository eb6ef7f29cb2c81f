import random
from collections import Counter

import numpy as np

from pathloom.llm import decontaminate as D


def shingles(text):
    ws = D.WORD((text or "").lower())
    return [tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))] if ws else []


def brute(docs, items):
    out = {}
    for d, text in docs:
        s = shingles(text)
        for i, item in items:
            want = Counter(shingles(item))
            n = sum(want.values())
            if not n or not s:
                continue
            size = min(n, len(s))
            best = max(sum((Counter(s[a : a + size]) & want).values()) / sum((Counter(s[a : a + size]) | want).values()) for a in range(len(s) - size + 1))
            if best >= D.SIMILARITY:
                out[d, i] = best
    return out


def corpus():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 60)))) for i in range(25)] + [(90, "just four words here"), (91, "a b c d e a b c d e a b c d e f"), (92, None), (93, ""), (None, "no id at all for this item"), (7, "second text of one id " * 3)]
    docs = [(1000, None), (1001, ""), (1002, "Just FOUR words, here!"), (1003, "a b c d e a b c d e a b c d e f"), (1004, "second text of one id " * 3)]
    for d in range(60):
        item = rng.choice(items[:25])[1].split()
        for _ in range(d % 4):
            item[rng.randrange(len(item))] = word()
        filler = [word() for _ in range(rng.randint(0, 200))]
        at = rng.randint(0, len(filler))
        docs.append((d, " ".join(filler[:at] + item + filler[at:])))
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    docs, items = corpus()
    want = brute(docs, [x for x in items if x[0] is not None])
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, similarity double").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contamination(df, bench).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    monkeypatch.setattr(D, "ITEMS", 300)  # in several passes
    again = {(r.doc_id, r.item_id): r.similarity for r in D.contamination(df, bench).groupBy("doc_id", "item_id").max("similarity").toDF("doc_id", "item_id", "similarity").collect()}
    assert again == got
    kept = D.keep_clean(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(df, bench).collect() == [] and D.keep_clean(df, bench).count() == 1
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert D.contamination(df.limit(0), items).collect() == []


def test_fingerprints_within_the_radius_are_found():
    rng = random.Random(1)
    index = D.Index([(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(20))) for i in range(200)])
    for _ in range(300):
        i = rng.randrange(200)
        bits = np.unpackbits(index.prints[i].view(np.uint8), bitorder="little")
        for b in rng.sample(range(128), rng.randint(0, D.RADIUS)):
            bits[b] ^= 1
        assert i in index.candidates(np.packbits(bits, bitorder="little").view("<u8"))
    # the index selects: another fingerprint meets few items
    met = [len(index.candidates(np.array([rng.getrandbits(64), rng.getrandbits(64)], dtype=np.uint64))) for _ in range(300)]
    assert sum(met) / len(met) < 0.12 * 200


def test_recall_on_the_drivers_documents(spark):
    """Windows of all documents that reach the similarity with an item: nearly all of them are within the radius."""
    folder = "/root/testdata/sf0.1"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    index, every = D.Index(items), D.Index(items)
    every.candidates = lambda fp: np.flatnonzero(np.bitwise_count(every.prints ^ fp).sum(axis=1) <= 128)
    texts = [r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    known, want, got = {}, set(), set()
    near = D.RADIUS
    for k, t in enumerate(texts):
        h = D.shingle_hashes(t, known)
        if len(h) and index.windows(h):
            got |= {(k, i) for i in index.matches(h)}
            try:
                D.RADIUS = 128
                want |= {(k, i) for i in every.matches(h)}
            finally:
                D.RADIUS = near
    assert got <= want and len(want) > 100 and len(got) >= 0.99 * len(want)
    print("contaminations", len(want), "found", len(got))
