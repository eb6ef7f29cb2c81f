"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Each partition of the vectors is worked through in blocks. A block has a sorted list for each dimension; a query reads
the lists from their better end (the largest components where its own is positive, the smallest where negative),
scores what it meets in full, and stops as soon as the bound for all unseen vectors (the inner product of the query
with the lists' current components) is below its kth best so far, which earlier blocks have raised already. The bound
is looked at whenever the depth has doubled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm import _common

#: Queries of one pass over the vectors, and vectors of one block of lists: both bound a task's memory.
QUERIES, BLOCK = 2048, 8192
#: Depth in the lists at which the bound is looked at first; it doubles until the bound allows to stop.
FIRST_DEPTH = 2


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """id, vec (array of long: floor(scale * x)); without null ids or vectors and those with null or non-finite components."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("vec"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of different ids (each id's best), ties to smaller ids."""
    want = k
    while True:
        if len(scores) > 4 * want:
            keep = scores >= np.partition(scores, len(scores) - want)[len(scores) - want]
            s, i = scores[keep], ids[keep]
        else:
            s, i, want = scores, ids, len(scores)
        order = np.lexsort((i, -s))
        s, i = s[order], i[order]
        if len(i) > 1:
            first = np.zeros(len(i), dtype=bool)
            first[np.unique(i, return_index=True)[1]] = True
            s, i = s[first], i[first]
        if len(i) >= k or want >= len(scores):
            return s[:k], i[:k]
        want *= 4


class Block:
    """Vectors with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray):
        self.ids, self.vecs = ids, vecs
        self.order = np.argsort(vecs, axis=0, kind="stable")

    def search(self, qs: np.ndarray, qids: np.ndarray, k: int, best: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Merges each query's best of this block into ``best``."""
        n, d = self.vecs.shape
        if n == 0:
            return
        if d == 0:
            for j in range(len(qs)):
                self._merge(j, np.zeros(n), self.ids, qids, k, best)
            return
        dims = np.arange(d)
        for j, q in enumerate(qs):
            up, down = dims[q > 0], dims[q < 0]
            seen = np.zeros(n, dtype=bool)
            before, depth = 0, min(FIRST_DEPTH, n)
            while True:
                new = np.zeros(n, dtype=bool)
                new[self.order[n - depth : n - before, up].ravel()] = True
                new[self.order[before:depth, down].ravel()] = True
                if depth == n:  # a query of zeros reads no list
                    new[:] = True
                new = np.flatnonzero(new & ~seen)
                seen[new] = True
                if len(new):
                    self._merge(j, self.vecs[new] @ q, self.ids[new], qids, k, best)
                bound = (q[up] * self.vecs[self.order[n - depth, up], up]).sum() + (q[down] * self.vecs[self.order[depth - 1, down], down]).sum()
                s = best[j][0]
                if depth == n or len(s) == k and bound < s[-1]:
                    break
                before, depth = depth, min(2 * depth, n)

    @staticmethod
    def _merge(j: int, scores: np.ndarray, ids: np.ndarray, qids: np.ndarray, k: int, best: list) -> None:
        other = ids != qids[j]
        if other.any():
            best[j] = _best(np.concatenate([best[j][0], scores[other]]), np.concatenate([best[j][1], ids[other]]), k)


def _exact(qs: list, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Floats where all products are exact in them, else Python's integers."""
    big = max((abs(int(x)) for v in (qs, vecs) if len(v) and len(v[0]) for x in (np.max(v), np.min(v))), default=0)
    kind = np.float64 if big * big * max(1, len(vecs[0]) if len(vecs) else 1) < 2**53 else object
    return np.array(qs).astype(kind), vecs.astype(kind)


def fagin_top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of ``vectors`` (id, vec) for each of ``queries`` (id, vec).

    A query's own id is no candidate. Ties go to the smaller id. Only vectors of the query's dimension take part. Ids
    that occur several times count once, with their best score (for a repeated query id: over all its rows). Fewer
    candidates give fewer rows; none (an empty table) gives no row. Scores beyond 64 bits are clamped to them.
    Queries go in blocks of QUERIES rows, each block sent to all partitions of the vectors; vectors aren't shuffled.
    """
    spark = vectors.sparkSession
    queries = queries.distinct()
    total = queries.count()
    blocks = max(1, -(-2 * total // QUERIES)) if total > QUERIES else 1
    found = []
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)) == b).collect() if blocks > 1 else queries.collect()
        if not own:
            continue
        groups: dict[int, list] = {}
        for r in own:
            groups.setdefault(len(r["vec"]), []).append((r["id"], list(r["vec"])))

        def run(batches: Iterator[pd.DataFrame], groups: dict = groups) -> Iterator[pd.DataFrame]:
            best = {d: [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in v] for d, v in groups.items()}

            def flush(d: int, ids: list, vecs: list) -> None:
                qs, vs = _exact([q for _, q in groups[d]], np.array(vecs).reshape(len(vecs), d))
                Block(np.array(ids, dtype=np.int64), vs).search(qs, np.array([i for i, _ in groups[d]]), k, best[d])

            held: dict[int, tuple[list, list]] = {d: ([], []) for d in groups}
            for pdf in batches:
                for i, v in zip(pdf["id"], pdf["vec"]):
                    if len(v) in held:
                        ids, vecs = held[len(v)]
                        ids.append(i), vecs.append(v)
                        if len(ids) >= BLOCK:
                            flush(len(v), ids, vecs)
                            held[len(v)] = ([], [])
            for d, (ids, vecs) in held.items():
                if ids:
                    flush(d, ids, vecs)
            low, high = -(2**63), 2**63 - 1
            for d, v in groups.items():
                for (qid, _), (s, i) in zip(v, best[d]):
                    if len(i):
                        yield pd.DataFrame({"query_id": np.full(len(i), qid), "vec_id": i, "score": np.array([min(high, max(low, int(x))) for x in s], dtype=np.int64)})

        part = vectors.mapInPandas(run, "query_id long, vec_id long, score long")
        found.append(_common.durable(part) if blocks > 1 else part)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
