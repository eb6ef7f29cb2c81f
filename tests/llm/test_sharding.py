import random
import zlib

from pathloom.llm import sharding as S


def brute(rows, shards):
    total, before, out, slots = sum(s for *_, s in rows), 0, [], {}
    for doc, crc, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        out.append((doc, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        before += size
    return out


def test_matches_brute_force(spark):
    rng = random.Random(1)
    texts = ["ü" * rng.randint(0, 300) if i % 3 else "same" for i in range(400)] + [None, ""]
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(9, texts[9])] * 2
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, size int, shard string").repartition(7)
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in S.shard_documents(df).collect()]
    want = brute([(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows], 16)
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)
    sums = [sum(r[1] for r in got if r[3] == k) for k in range(16)]
    assert max(sums) - min(sums) <= 2 * max(r[1] for r in got)


def test_few_and_none(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    rows = S.shard_documents(df).collect()
    assert len(rows) == 2 and {r.law for r in rows} == {"bytes"} and all(r.slot == 0 and r.grown_shard is None for r in rows)
    assert S.shard_documents(df.limit(0)).collect() == []
    zero = spark.createDataFrame([(1, None), (2, 0)], "k int, size long")
    assert [(r.shard, r.slot) for r in S.shard_by_bytes(zero, 4, ["k"]).orderBy("k").collect()] == [(0, 0), (0, 1)]
