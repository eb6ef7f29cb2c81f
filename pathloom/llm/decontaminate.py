"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

A document's windows have the sizes of the items; those that share fewer shingles with items of their size than the
similarity takes can't reach it and aren't looked at (prefix sums over the document's hashed shingles tell). A window's SimHash
of 128 bits is looked up in eight tables, one for each block of 16 bits: a table gives, for a block, the items whose own
block is within RADIUS div 8 bits of it, about 1 % of others by chance. Fingerprints within RADIUS bits agree so in at
least one block, so none is missed. What is found is verified by the exact similarity of the weighted shingles: the sum of
the lesser counts over that of the larger ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm._common import Shipped, durable, map_rows, mapped

#: Words of a shingle; bits that fingerprints of similar texts may differ in (at a similarity of 0.8, about 19 of the 128
#: differ on average, with a deviation of 4); least similarity.
WIDTH, RADIUS, SIMILARITY = 5, 31, 0.8
#: Characters of items that one pass over the documents takes, and windows that are fingerprinted at a time.
ITEMS, WINDOWS = 1_000_000, 2048
BLOCKS = 8
#: What a block of 16 bits may differ by.
NEAR = np.array([m for m in range(1 << 16) if m.bit_count() <= RADIUS // BLOCKS], dtype=np.uint16)
WORD = re.compile(r"\w+").findall
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, known: dict[str, int]) -> np.ndarray:
    """Hashes of the shingles of a text's words (lower-cased \\w+); of fewer words, one of the whole sequence."""
    import xxhash

    words = WORD(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    new = set(words).difference(known)
    if len(known) + len(new) > 500_000:
        known.clear()
        new = set(words)
    known.update((w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in new)
    w = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - WIDTH + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(WIDTH, len(w))):
        h = (h ^ w[k : k + n]) * MULTIPLY
        h ^= h >> np.uint64(31)
    return h


def simhash(h: np.ndarray) -> np.ndarray:
    """Fingerprints of the rows of ``h``, as two numbers each."""
    other = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    out = []
    for x in (h, other ^ other >> np.uint64(33)):
        bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8), axis=-1, bitorder="little").reshape(*x.shape, 64)
        ones = 2 * bits.sum(axis=-2, dtype=np.int64) > x.shape[-1]
        out.append(np.packbits(ones, axis=-1, bitorder="little").view("<u8")[..., 0])
    return np.stack(out, axis=-1)


class Index:
    """The items of one pass."""

    def __init__(self, items: list[tuple[int, str]]):
        known: dict[str, int] = {}
        self.ids, self.counts, self.sizes, prints = [], [], [], []
        for i, text in items:
            h = shingle_hashes(text or "", known)
            if len(h):
                self.ids.append(i)
                self.counts.append(Counter(h.tolist()))
                self.sizes.append(len(h))
                prints.append(simhash(h[None])[0])
        self.prints = np.array(prints, dtype=np.uint64).reshape(-1, 2)
        # which sizes of windows a shingle asks for
        asked: dict[int, set[int]] = {}
        for c, n in zip(self.counts, self.sizes):
            for h in c:
                asked.setdefault(h, set()).add(n)
        self.asked = asked
        self.hashes = np.array(sorted(asked), dtype=np.uint64)
        self.bitmap = np.zeros(1 << 20, dtype=bool)
        self.bitmap[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        # by block: the items that each value stands near to, and where the value's begin
        self.tables = []
        for own in self.prints.view("<u2").reshape(-1, BLOCKS).T:
            value = (own[:, None] ^ NEAR).ravel()
            order = np.argsort(value, kind="stable")
            self.tables.append((np.searchsorted(value[order], np.arange((1 << 16) + 1)), (order // len(NEAR)).astype(np.int32)))

    def candidates(self, fp: np.ndarray) -> np.ndarray:
        """The items with a block near to the fingerprint's."""
        found = [items[starts[v] : starts[v + 1]] for (starts, items), v in zip(self.tables, fp.view("<u2").tolist())]
        return np.unique(np.concatenate(found))

    def windows(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """Starts of the windows of each size that share as many shingles with items of that size as similarity takes."""
        maybe = np.flatnonzero(self.bitmap[(h >> np.uint64(44)).astype(np.int64)])
        if not len(maybe):
            return {}
        place = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        at = maybe[self.hashes[place] == h[maybe]]
        hits: dict[int, list[int]] = {}
        for p, x in zip(at.tolist(), h[at].tolist()):
            for n in self.asked[x]:
                hits.setdefault(n, []).append(p)
        out = {}
        for n, places in hits.items():
            size = min(n, len(h))
            # common / (n + size - common) >= SIMILARITY; a bit less, for rounding
            need = SIMILARITY / (1 + SIMILARITY) * (n + size) - 1e-6
            if len(places) >= need:
                total = np.zeros(len(h) + 1, np.int32)
                total[np.array(places) + 1] = 1
                total = np.cumsum(total)
                out[n] = np.flatnonzero(total[size:] - total[: len(total) - size] >= need)
        return out

    def matches(self, h: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """By item: similarity, first word and number of shingles of the best (then first, then shortest) window."""
        best: dict[int, tuple[float, int, int]] = {}
        for n, starts in self.windows(h).items():
            size = min(n, len(h))
            for k in range(0, len(starts), max(1, WINDOWS // size)):
                part = starts[k : k + max(1, WINDOWS // size)]
                rows = h[part[:, None] + np.arange(size)]
                for start, row, fp in zip(part.tolist(), rows, simhash(rows)):
                    found = self.candidates(fp)
                    found = found[np.bitwise_count(self.prints[found] ^ fp).sum(axis=1) <= RADIUS]
                    if not len(found):
                        continue
                    mine = Counter(row.tolist())
                    for i in found.tolist():
                        lo, hi = sorted((self.sizes[i], size))
                        if lo < SIMILARITY * hi:
                            continue
                        theirs = self.counts[i]
                        common = sum(min(c, theirs[x]) for x, c in mine.items() if x in theirs)
                        s = common / (self.sizes[i] + size - common)
                        if s >= SIMILARITY:
                            new, old = (s, -start, -size), best.get(self.ids[i])
                            if old is None or new > old:
                                best[self.ids[i]] = new
        return {i: (s, -a, -b) for i, (s, a, b) in best.items()}


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of at most ITEMS characters (or one item), so that what is sent to tasks is bounded."""
    part, held = [], 0
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).distinct().orderBy(id_col, text_col)
    for r in items.toLocalIterator():
        if part and held + len(r[1]) > ITEMS:
            yield part
            part, held = [], 0
        part.append((r[0], r[1]))
        held += len(r[1])
    if part:
        yield part


def contamination(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``keys``, item_id, similarity, start_word, n_words: for each row and item, the most similar window if it reaches
    SIMILARITY.

    Items without words (null, empty) match nothing; items of fewer than WIDTH words are one shingle. Windows are cut to
    the document where that is shorter. Null texts count as empty. Repeated rows stay repeated, repeated items count
    once, items that share an id are both searched. Null ids of items are left out. Empty tables give an empty result.
    """
    out = None
    for part in _passes(benchmark, item_col, item_text):
        index = Shipped(docs.sparkSession, Index(part))

        def run(parts: Iterator[list], index=index) -> Iterator[dict]:
            known: dict[str, int] = {}
            own = index.load()
            for texts in parts:
                yield {"found": [[{"item_id": int(i), "similarity": s, "start_word": a, "n_words": b + WIDTH - 1} for i, (s, a, b) in sorted(own.matches(h).items())] if len(h := shingle_hashes(t, known)) else [] for t in texts]}

        found = map_rows(docs, list(keys), text_col, run, "found array<struct<item_id:long,similarity:double,start_word:int,n_words:int>>")
        found = found.where(F.size("found") > 0).select(*keys, F.inline("found"))
        out = found if out is None else durable(out).unionAll(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item_id long, similarity double, start_word int, n_words int")
        return docs.select(*keys).limit(0).crossJoin(out)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) that hold no benchmark item, as contamination() finds them.

    Null and empty texts hold none; null ids are no matter; repeated rows stay or go together; without items all rows stay,
    and an empty table stays empty. Only the text goes to Python.
    """
    for part in _passes(benchmark, item_col, item_text):
        index = Shipped(docs.sparkSession, Index(part))

        def begin(index=index):
            own, known = index.load(), {}
            return lambda texts: [not (len(h := shingle_hashes(t, known)) and own.matches(h)) for t in texts]

        docs = docs.where(mapped(F.col(text_col), begin, "boolean"))
    return docs
