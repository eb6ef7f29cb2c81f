"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader (FTRL).

Words (runs of letters, digits and underscores, lower-cased) and signs (runs of anything else but white space) are
hashed, alone and in pairs, into 2^18 weights; so is the shape of a pair of equal words, whatever the word. A text is its sparse vector of counts, of length 1; its score is the
logistic function of one sparse dot product with the weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm._common import map_rows, mapped, text_of
from pathloom.llm.labelled import one_label_each, remainder, sample

BITS = 18
#: The hash of the shape of a pair of equal words.
SAME = zlib.crc32(b"<same word>") & (1 << BITS) - 1
#: Labelled rows that the classifier is fitted on, at most; passes over them; hashes of words kept by a task.
SAMPLE, EPOCHS, KNOWN = 12_000, 3, 500_000
#: FTRL: rate, its offset, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 1.5, 1.0, 0.003, 0.0
TOKEN = re.compile(r"\w+|[^\w\s]+").findall


class Features:
    """Sparse vectors of texts."""

    def __init__(self) -> None:
        self.hashes: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = TOKEN(text.lower())
        hashes = self.hashes
        new = set(tokens).difference(hashes)
        if len(hashes) + len(new) > KNOWN:
            hashes.clear()
            new = set(tokens)
        hashes.update((t, zlib.crc32(t.encode("utf-8", "surrogatepass"))) for t in new)
        one = np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
        same = np.full(int((one[1:] == one[:-1]).sum()), SAME, dtype=np.uint64)
        ids, n = np.unique(np.concatenate([one & np.uint64((1 << BITS) - 1), two, same]).astype(np.int32), return_counts=True)
        x = n.astype(np.float64)
        return ids, x / np.sqrt((x * x).sum()) if len(x) else x


class Ftrl:
    """FTRL-proximal for the logistic loss, one weight a feature and an intercept."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, ids: np.ndarray) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, ids: np.ndarray, x: np.ndarray, y: int) -> None:
        ids, x = np.append(ids, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(ids)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        s = (np.sqrt(self.n[ids] + g * g) - np.sqrt(self.n[ids])) / ALPHA
        self.z[ids] += g - s * w
        self.n[ids] += g * g

    def all(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z)))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn_from, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray | None:
    """The weights, the intercept last; None without two classes to learn from.

    ``learn_from``: a condition on ``_id``. Fitted on at most ``most`` labelled rows, by one task that reads them in the
    order of a hash of their ids, so the result doesn't depend on partitions.
    """
    ids = sample(one_label_each(labels, label).where(learn_from), most)
    # at most `most` rows of two numbers: small enough to broadcast
    rows = docs.select(F.col(id_col).alias("_id"), text_of(docs, text_col).alias("_text")).join(F.broadcast(ids), "_id")
    # of rows that share an id the one with the least text, so that the one task's rows are bounded
    rows = rows.groupBy("_id").agg(F.min(F.struct("_label", "_text")).alias("x")).select("_id", "x.*")
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id").select("_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, data = Features(), []
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                data += [(*(a.astype(k) for a, k in zip(vector(t), (np.int32, np.float32))), y) for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
        positive = sum(y for *_, y in data)
        if not 0 < positive < len(data):
            return
        model = Ftrl(1 << BITS)
        for _ in range(EPOCHS):
            for ids, x, y in data:
                model.learn(ids, x.astype(np.float64), y)
        yield pa.RecordBatch.from_arrays([pa.array([model.all().astype("<f4").tobytes()], pa.binary())], names=["weights"])

    found = rows.mapInArrow(run, "weights binary").collect()
    return np.frombuffer(found[0][0], dtype="<f4").astype(np.float64) if found else None


def scorer(weights: np.ndarray | None) -> Callable[[], Callable[[list[str]], list[float]]]:
    """Gives a function from texts to their scores (0.5 for every text without a model)."""

    def begin() -> Callable[[list[str]], list[float]]:
        vector = Features()

        def scores(texts: list[str]) -> list[float]:
            out = []
            for t in texts:
                ids, x = vector(t)
                at = 0.0 if weights is None else float(weights[ids] @ x + weights[-1])
                out.append(1 / (1 + np.exp(-min(35.0, max(-35.0, at)))))
            return out

        return scores

    return begin


def score_texts(docs: DataFrame, weights: np.ndarray | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and score."""
    begin = scorer(weights)

    def run(parts: Iterator[list]) -> Iterator[dict]:
        scores = begin()
        for texts in parts:
            yield {"score": scores(texts)}

    return map_rows(docs, keep, text_col, run, "score double")


def score_quality(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, label: str = "quality", modulus: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Learns from labelled rows whose crc32(doc_id) modulo ``modulus`` is not ``held``. A null text counts as empty and
    has a score too; null ids count as '' for held_out; repeated rows stay repeated; other columns are not read. Without
    labels of both classes every score is 0.5. An empty table gives an empty result.
    """
    weights = fit(train_docs if train_docs is not None else docs, labels, label, remainder(F.col("_id"), modulus) != held, id_col=id_col, text_col=text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), (remainder(F.col(id_col), modulus) == held).alias("held_out"), F.col(text_col).alias("text"))
    return score_texts(source, weights, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held: int = 1, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all their columns, whatever their names) whose score is at least ``least``.

    Null texts count as empty and have a score too; null ids are no matter; repeated rows stay or go together. Without labels
    of both classes every score is 0.5, and an empty table stays empty. Only the text goes to Python.
    """
    weights = fit(docs, labels, label, remainder(F.col("_id"), modulus) != held, id_col=id_col, text_col=text_col)
    return docs.where(mapped(F.col(text_col), scorer(weights), "double") >= least)
