import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pathloom.llm import packing as P
from pathloom.llm import token_counts as C
from pathloom.llm.queries import tokenizer

TEXTS = ["", None, " ", "  a", "a  b", "a \n\n b  ", "x\x1cy \x1c z", "a\xa0 b\xa0\xa0c", "<|endoftext|> a <|startoftext|>", "don't  'll we've", "​ a　　b", "\t\ta", "a\x85b \x85 c", "İstanbul ΣΑΣ", "A b ́x é é", "12 345x", "\x00 \x00a", "日本語 текст", "word " * 3000, "🙂🙂 ok", "don't" * 50]


def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [r.text for r in docs] + TEXTS


def test_counts_are_the_librarys(spark):
    path = tokenizer("byte_bpe_50k.json")
    texts = corpus(spark)
    df = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = C.token_counts(df, path).collect()
    library = C.PieceCounter(path).tokenizer
    want = [(i if i != 3 else None, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_pre_tokens_are_the_librarys():
    """Between letters and a digit, every code point; and texts of many kinds."""
    counter = C.PieceCounter(tokenizer("byte_bpe_50k.json"))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4096):
        texts = [f"a{c}1 {c}b" for c in points[i : i + 4096]]
        tokens, token, text, n, besides = counter.split(texts)
        pieces = np.array([counter.pieces(p) for p in tokens])
        got = np.bincount(text, weights=pieces[token] * n, minlength=len(texts))
        assert got.tolist() == [len(e) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)] and not any(besides)


@pytest.mark.parametrize("bits", [14, 2])
def test_blocks_of_any_size(spark, monkeypatch, bits):
    """Small blocks, frequencies that take several entries, and tokens of many documents (salted)."""
    from pathloom.llm import postings as I

    entries, starts = I.packed(np.array([2, 1, 2, 0, 0]), np.array([1, 0, 1, 0, 0]), np.array([20, 1, 30, 1, 1]))
    assert starts.tolist() == [0, 1, 2] and ((entries[2:] >> I.BITS) + 1).sum() == 50 and (entries & 1).tolist() == [0, 0] + [1] * 13
    monkeypatch.setattr(I, "CHARS", 200)
    monkeypatch.setattr(I, "BITS", bits)
    monkeypatch.setattr(I, "LONG", 4)
    path = tokenizer("byte_bpe_50k.json")
    texts = [f"the cat {i} the" * (i % 5) for i in range(60)] + TEXTS
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    library = C.PieceCounter(path).tokenizer
    assert {r.doc_id: r.n_tokens for r in C.token_counts(df, path).collect()} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert C.token_counts(df.limit(0), path).collect() == []


def test_word_ids_are_the_librarys(spark):
    path = tokenizer("word_bpe_49k.json")
    encoder, small, slow = P.WordIds(path), P.WordIds(path, known=3), P.WordIds(path)
    assert encoder.ranked
    slow.ranked = None
    for t in corpus(spark):
        want = np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder.encode(t or "") == want
        if t in TEXTS:
            assert small.encode(t or "") == slow.encode(t or "") == want


def test_word_ids_of_every_code_point():
    """Between letters and a digit, so that a code point's class decides where words are cut."""
    encoder = P.WordIds(tokenizer("word_bpe_49k.json"), known=1 << 21)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4096):
        texts = [f"a{c}1" for c in points[i : i + 4096]]
        for t, want in zip(texts, encoder.tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert encoder.encode(t) == np.array(want.ids, dtype="<u4").tobytes(), hex(ord(t[1]))


def slow_best_two_fit(lengths, capacity):
    """Document by document: fill with the longest that fits, then exchange the smallest for the pair that fits best."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own, gap = [], capacity
        for x in list(left):
            if x <= gap:
                own.append(x), left.remove(x)
                gap -= x
        while gap:
            small = min(own)
            pairs = [(left[i] + left[j], max(left[i], left[j])) for i in range(len(left)) for j in range(i) if left[i] + left[j] <= gap + small]
            best = max(pairs, default=(0, 0))[0]
            if best <= small:
                break
            # of pairs of one sum, the one with the smallest member
            least = min(min(left[i], left[j]) for i in range(len(left)) for j in range(i) if left[i] + left[j] == best)
            own.remove(small), left.remove(least), left.remove(best - least)
            own += [least, best - least]
            left = sorted([*left, small], reverse=True)
            gap = gap + small - best
        bins.append(sorted(own))
    return sorted(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plans_match_the_method_document_by_document(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in rng.integers(1, 60 if seed % 2 else 25, 60)]
    plan = P.best_two_fit(Counter(lengths), 100)
    assert sorted(sorted(own) for own, times in plan for _ in range(times)) == slow_best_two_fit(lengths, 100)


def check_packing(rows, ids_by_doc, capacity):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert pieces.keys() == ids_by_doc.keys()
    for d, ids in ids_by_doc.items():
        own = sorted(pieces[d], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and len(part) == r.length == min(capacity, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, capacity):
    path = tokenizer("word_bpe_49k.json")
    texts = corpus(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = P.pack_documents(df, path, capacity, 1, with_ids=True).collect()
    library = P.WordIds(path).tokenizer
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    bins = check_packing(rows, ids, capacity)
    assert bins <= 1.01 * sum(map(len, ids.values())) / capacity + 1
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_pair_takes_the_smallests_place():
    # greedy: 60 + 30 leaves 10; 22 + 18 fit the place of 30 exactly
    plan = P.best_two_fit({60: 1, 30: 1, 22: 1, 18: 1}, 100)
    assert sorted(plan[0][0]) == [18, 22, 60] and len(plan) == 2


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_everything(seed):
    rng = np.random.default_rng(seed)
    histogram = Counter(int(x) for x in rng.integers(1, 101 if seed % 2 else 12, 500))
    plan = P.best_two_fit(histogram, 100)
    got = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 100 and times > 0
        for x in lengths:
            got[x] += times
    assert got == histogram
    assert sum(t for _, t in plan) <= 1.03 * sum(x * n for x, n in histogram.items()) / 100 + 1


def test_pack_of_other_rows(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("b", 3, "x"), ("b", 3, "x"), ("c", None, "x"), (None, 7, "x")], "k string, length int, offset_ string")
    rows = P.pack(df, 10).collect()
    assert sorted((r.k or "", r.length, r.sequence_id is None) for r in rows if r.length is None) == [("c", None, True)]
    assert len({r.sequence_id for r in rows} - {None}) == 2
    assert P.pack(df.limit(0), 10).collect() == []
    names = ["length", "_part", "_row", "_length", "_rank", "_before", "sequence_id", "offset", "c0"]
    odd = P.pack(spark.createDataFrame([tuple(range(3, 12)), tuple(range(4, 13))], names), 10)
    assert odd.columns == [c for c in names if c not in ("sequence_id", "offset")] + ["sequence_id", "offset"]
    assert sorted((r["_part"], r["c0"], r.sequence_id) for r in odd.collect()) == [(4, 11, 0), (5, 12, 0)]
    with pytest.raises(ValueError, match="between 1 and 5"):
        P.pack(df, 5)
