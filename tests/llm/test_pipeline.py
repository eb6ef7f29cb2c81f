import re
from collections import defaultdict

import corpus_pipeline as C

from pathloom.llm import decontaminate as D
from pathloom.llm import packing as P
from pathloom.llm import secrets as S
from pathloom.llm.quality import score_quality
from pathloom.llm.queries import tokenizer

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    outs = []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outs.append(docs)
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    texts = [{r.doc_id: r.text for r in o.collect()} for o in outs[:4]]
    assert all(o.columns == columns for o in outs[:4])
    # quality: what the classifier accepts
    good = {r.doc_id for r in score_quality(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")).collect() if r.predicted == 1}
    assert texts[0] == {d: first[d] for d in good} and 0 < len(good) < len(first)
    # near-duplicates: the smallest of each group of texts that are similar by their 5-word shingles
    ids = sorted(texts[0])
    sets = {d: shingles(t) for d, t in texts[0].items()}
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            union = len(sets[a] | sets[b])
            if not union or len(sets[a] & sets[b]) >= 0.8 * union:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert texts[1] == {d: texts[0][d] for d in ids if root(d) == d}
    # contamination: no item's window is similar
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    index = D.Index(items)
    clean = {d for d, t in texts[1].items() if not index.matches(D.shingle_hashes(t, {}))}
    assert texts[2] == {d: texts[1][d] for d in clean}
    # secrets: redacted, and the length follows
    guesser = S.Guesser(S.word_ranks(S.vocabulary_words(tokenizer("word_bpe_49k.json"))))
    assert texts[3] == {d: S.redact(t, guesser=guesser) for d, t in texts[2].items()}
    assert all(r.n_chars == len(r.text) for r in outs[3].collect())
    # packing: every id once
    library = P.WordIds(tokenizer("word_bpe_49k.json")).tokenizer
    lengths = defaultdict(int)
    for r in outs[4].collect():
        lengths[r.doc_id] += r.length
    assert lengths == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts[3].items()}
    run = C.run(spark, FOLDER)
    assert sorted(map(tuple, run.drop("sequence_id", "offset").collect())) == sorted(map(tuple, outs[4].drop("sequence_id", "offset").collect()))
