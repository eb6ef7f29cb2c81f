import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import quality as Q
from pathloom.llm import toxicity as T
from pathloom.llm.queries import op4_toxicity, op5_quality

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("query", "label", "modulus", "held", "least"), [(op4_toxicity, "toxic", 5, 0, 0.97), (op5_quality, "quality", 3, 1, 0.97)])
def test_held_out_accuracy(spark, query, label, modulus, held, least):
    got = query(spark, FOLDER)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in rows)
    out = [r for r in rows if r.held_out]
    for y in (0, 1):
        own = [r for r in out if r[label] == y]
        assert sum(r.predicted == y for r in own) / len(own) >= (0.85 if label == "toxic" and y else least), y


@pytest.mark.parametrize("score", [T.score_toxicity, Q.score_quality])
def test_odd_rows(spark, score):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "some words", "c"), (4, "x" * 100_000 + " y" * 10_000, "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = score(docs, none).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    one = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 0), (4, None, None), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert score(docs, one).count() == 5
    both = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    texts = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, "vile vile rot").otherwise("fine day here").alias("text"))
    rows = score(texts, both).collect()
    assert len(rows) == 60
    assert score(docs.limit(0), both).collect() == []


class Brute:
    """The models by their definition, from lists of words of each class."""

    def __init__(self, toxic, ordinary):
        self.n = [{y: Counter() for y in "tob"} for _ in range(T.ORDER + 1)]
        for y, words in (("t", toxic), ("o", ordinary)):
            for w in words:
                s = T.BEGIN * (T.ORDER - 1) + w + T.END
                for i in range(T.ORDER - 1, len(s)):
                    self.n[T.ORDER][y][s[i - T.ORDER + 1 : i + 1]] += 1
        self.n[T.ORDER]["b"] = self.n[T.ORDER]["t"] + self.n[T.ORDER]["o"]
        for k in range(T.ORDER - 1, 0, -1):
            for y in "tob":
                for g in self.n[k + 1][y]:
                    self.n[k][y][g[1:]] += 1

    def p(self, y, k, h, w):
        if k == 0:
            return 1 / (len(self.n[1]["b"]) + 1)
        if k < T.LOWEST:
            y = "b"
        strength = T.STRENGTH if k >= T.LOWEST else 0
        after = {g[-1]: n for g, n in self.n[k][y].items() if g[:-1] == h}
        total = sum(after.values()) + strength
        lower = self.p(y, k - 1, h[1:], w)
        return (max(after.get(w, 0) - T.DISCOUNT, 0) + (T.DISCOUNT * len(after) + strength) * lower) / total if total else lower

    def difference(self, word):
        s = T.BEGIN * (T.ORDER - 1) + word + T.END
        at = [(s[i - T.ORDER + 1 : i], s[i]) for i in range(T.ORDER - 1, len(s))]
        return sum(math.log(self.p("t", T.ORDER, h, w) / self.p("o", T.ORDER, h, w)) for h, w in at)


def test_models_match_their_definition(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeü") for _ in range(rng.randint(1, 7)))
    toxic, ordinary = [word() for _ in range(60)] + ["grumblek"] * 9, [word() for _ in range(300)]
    rows = [(1, " ".join(toxic[:30])), (1, " ".join(toxic[30:]).upper()), *((0, ", ".join(ordinary[i : i + 50])) for i in range(0, 300, 50)), (0, ""), (1, "12 _")]
    counts = T._counts(spark.createDataFrame(rows, "_label int, _text string").repartition(3))
    table = T.model(counts).toPandas()
    assert not table.duplicated(["hi", "lo"]).any()
    own, brute = T.Model(*(table[c].to_numpy() for c in ("hi", "lo", "d", "b"))), Brute(toxic, ordinary)
    words = sorted({*toxic, *ordinary[:60], "grumbleks", "ungrumblek", "grumbxek", "zzz", "", "ünseen", "a" * 30})
    for w, d in zip(words, own.words(words)):
        assert abs(d - brute.difference(w)) < 1e-4 * (1 + len(w)), w
    # the probabilities of all letters and of an unknown one add up to one
    letters = {g[-1] for g in brute.n[1]["b"]}
    for y in "to":
        for h in ("\x01" * 5, "grumb", "abcab", "zzzzz"):
            assert abs(sum(brute.p(y, T.ORDER, h, w) for w in [*letters, "?"]) - 1) < 1e-9
    # an expression that is known in part only is told by its parts; of an unknown one nothing is known
    said = dict(zip(words, own.words(words)))
    assert min(said["grumbleks"], said["ungrumblek"], said["grumbxek"]) > 2 and abs(said["zzz"]) < 1.5


def test_a_table_too_large_to_be_sent_is_joined(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(1, None), (None, ""), (None, "x"), (3, "word " * 5000)], "doc_id long, text string"))
    sent = T.score_toxicity(rows, labels)
    monkeypatch.setattr(T, "SENT", 0)
    joined = T.score_toxicity(rows.repartition(3), labels)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    a, b = (sorted(map(tuple, x.collect()), key=key) for x in (sent, joined))
    assert len(a) == rows.count() and all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-6 for x, y in zip(a, b))
    assert len({x[2] for x in a}) > 100


def test_the_result_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a, b = Q.score_quality(docs, labels), Q.score_quality(docs.repartition(7), labels.repartition(3))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_grams_are_told_apart_whatever_their_letters():
    # one number mixed from both halves is the same for these two
    hi, lo, _ = T.letters(["habpcd", "oabıcd"])
    hi, lo = hi[[5, 12]], lo[[5, 12]]
    d, b = np.array([3.0, -2.0], np.float32), np.array([0.5, np.nan], np.float32)
    both, one, none = T.Model(hi, lo, d, b), T.Model(hi[:1], lo[:1], d[:1], b[:1]), T.Model(hi[:0], lo[:0], d[:0], b[:0])
    assert both._at(hi, lo, both.d).tolist() == [3.0, -2.0] and np.isnan(both._at(hi, lo, both.b)).tolist() == [False, True]
    assert np.isnan(one._at(hi, lo, one.d)).tolist() == [False, True] and np.isnan(none._at(hi, lo, none.d)).all()
    # every first and fourth letter of 500, as rows or not
    x, y = (v.ravel().astype(np.int64) for v in np.meshgrid(np.arange(97, 597), np.arange(97, 597)))
    hi, lo, d = x << 42 | 97 << 21 | 98, y << 42 | 99 << 21 | 100, (x * 1000 + y).astype(np.float32)
    row = np.random.default_rng(3).random(len(x)) < 0.5
    own = T.Model(hi[row], lo[row], d[row], d[row])
    got = own._at(hi, lo, own.d)
    assert np.array_equal(got[row], d[row]) and np.isnan(got[~row]).all()
    # a half of a row, or what is beyond all rows, is no row
    assert np.isnan(own._at(hi[:2] + [0, 1 << 62], lo[:2] + [1, 0], own.d)).all()


@pytest.mark.parametrize("sent", [True, False])
def test_words_of_any_letters_are_scored(spark, monkeypatch, sent):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, "habpcd habpcd rot").otherwise("oabıcd fine day").alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    if not sent:
        monkeypatch.setattr(T, "SENT", 0)
    rows = T.score_toxicity(docs, labels).collect()
    assert len(rows) == 60 and all(r.predicted == r.doc_id % 2 for r in rows)


def test_what_is_sent_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, "vile rot").otherwise("fine day").alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    table, sent, *_ = T.fit(docs, labels, "toxic", F.lit(True), F.col("_id") < 4)
    assert sent.load().bytes() > 16 * table.count()
    monkeypatch.setattr(T, "SENT", table.count())
    assert T.fit(docs, labels, "toxic", F.lit(True), F.col("_id") < 4)[1] is None
