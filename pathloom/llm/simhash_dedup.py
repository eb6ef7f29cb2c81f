"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints at most ``radius`` bits apart share at least ``8 - radius`` of their eight positional bytes. A list of the
index holds the fingerprints that have given bytes at given positions: at a radius of 4, at 20 sets of three positions
that are chosen so that any four positions hold one of them (a Turan system). A pair that reaches the least number of
matches so meets in a list; there its shared positional bytes are tallied, pairs below the least number are dropped,
and the others' bits are compared. Lists hold distinct fingerprints only (copies are represented by one).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm._common import durable, map_rows
from pathloom.llm.components import HOT, components, join_hot

#: Shingles whose bits are counted at a time, and the longest side of a block of pairs: both bound memory.
CHUNK, SIDE = 1 << 14, 1024
#: Members of a list that one task may hold.
SLICE = 16_384
#: Members of a slice where every pair of a list is wanted, and pairs that are held at a time: both bound memory.
SLICE_OF_PAIRS, HELD_PAIRS = 2048, 1 << 20
UPPER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str, width: int = 4) -> int:
    """SimHash of the shingles of ``width`` words, repeats included; 0 for a text without words."""
    return int(wide_fingerprint(text, width, 1)[0])


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A k-th hash from a shingle's hash; the hash itself for k = 0."""
    if k == 0:
        return h
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _shingles(text: str, width: int) -> list[str]:
    """Shingles of ``width`` words, repeats included; a shorter text is one shingle, one without words has none."""
    words = text.translate(UPPER).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    if "" in words:
        words = [w for w in words if w]
    if len(words) <= width:
        return [" ".join(words)] if words else []
    return list(map(" ".join, zip(*(words[i:] for i in range(width)))))


def _hashes(shingles: list[str]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles], dtype="<u8")


def _simhash(hashes: np.ndarray, longs: int) -> np.ndarray:
    ones = np.zeros(64 * longs, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        h = hashes[i : i + CHUNK]
        for k in range(longs):
            bits = np.unpackbits(np.ascontiguousarray(_mixed(h, k)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[64 * k : 64 * k + 64] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def wide_fingerprint(text: str, width: int, longs: int) -> np.ndarray:
    """SimHash of ``longs`` times 64 bits; the first 64 are fingerprint()'s."""
    return _simhash(_hashes(_shingles(text, width)), longs)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Hashes of the different shingles, sorted."""
    return np.unique(_hashes(_shingles(text, width)))


def fingerprints(docs: DataFrame, keys: list[str], width: int = 4, text_col: str = "text") -> DataFrame:
    """``keys`` and fp (the fingerprint as a signed long) for each row; a null text counts as empty."""

    def run(parts: Iterator[list]) -> Iterator[dict]:
        for texts in parts:
            yield {"fp": np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64)}

    return map_rows(docs, keys, text_col, run, "fp long")


def _digests(sets: list[np.ndarray]) -> dict:
    import xxhash

    digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8") for s in sets])
    return {"n": np.array([len(s) for s in sets]), "d0": digests[:, 0].copy(), "d1": digests[:, 1].copy()}


def _set_prints(docs: DataFrame, keys: list[str], width: int, longs: int, text_col: str = "text") -> DataFrame:
    """``keys``, n, d0, d1 (size and digest of the set of shingles) and fp0, fp1, ... (the set's SimHash) for each row."""

    def run(parts: Iterator[list]) -> Iterator[dict]:
        for texts in parts:
            sets = [shingle_set(t, width) for t in texts]
            prints = np.array([_simhash(s, longs) for s in sets], dtype=np.uint64).view(np.int64)
            yield _digests(sets) | {f"fp{k}": prints[:, k].copy() for k in range(longs)}

    return map_rows(docs, keys, text_col, run, "n long, d0 long, d1 long, " + ", ".join(f"fp{k} long" for k in range(longs)))


def _set_hashes(docs: DataFrame, keys: list[str], width: int, text_col: str = "text") -> DataFrame:
    """``keys``, n, d0, d1 and hashes (of the different shingles) for each row."""

    def run(parts: Iterator[list]) -> Iterator[dict]:
        for texts in parts:
            sets = [shingle_set(t, width) for t in texts]
            yield _digests(sets) | {"hashes": [s.view(np.int64) for s in sets]}

    return map_rows(docs, keys, text_col, run, "n long, d0 long, d1 long, hashes array<long>")


def _tally(a: np.ndarray, b: np.ndarray, matches: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that share enough positional bytes and then differ in few enough bits. Rows are fingerprints."""
    differ = a[:, None] ^ b[None, :]
    shared = (differ.view(np.uint8).reshape(*differ.shape[:2], -1) == 0).sum(axis=2)
    i, j = np.nonzero(shared >= matches)
    near = np.bitwise_count(differ[i, j]).sum(axis=1) <= radius
    return i[near], j[near]


def _join_runs(ids: np.ndarray, fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, matches: int, radius: int) -> list[np.ndarray]:
    """Links within each run starts[i]:ends[i]; short runs of one length are worked through together."""
    out = []
    sizes = ends - starts
    for n in np.unique(sizes):
        at = starts[sizes == n]
        if n <= 8:
            rows = at[:, None] + np.arange(n)
            for i, j in combinations(range(int(n)), 2):
                for k in range(0, len(rows), 1 << 16):
                    x, y = rows[k : k + (1 << 16), i], rows[k : k + (1 << 16), j]
                    differ = fps[x] ^ fps[y]
                    shared = (differ.view(np.uint8).reshape(len(x), -1) == 0).sum(axis=1)
                    near = (shared >= matches) & (np.bitwise_count(differ).sum(axis=1) <= radius)
                    out.append(np.stack([ids[x[near]], ids[y[near]]], axis=1))
        else:
            out.extend(_join_sides(ids[k : k + n], fps[k : k + n], None, None, matches, radius) for k in at)
    return out


def _join_sides(ids: np.ndarray, left: np.ndarray, other_ids: np.ndarray | None, right: np.ndarray | None, matches: int, radius: int) -> np.ndarray:
    """Links within ``left`` (right None) or between the two; only such as join groups that weren't joined before."""
    members = ids if right is None else np.concatenate([ids, other_ids])
    parent = list(range(len(members)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i in range(0, len(left), SIDE):
        a = left[i : i + SIDE]
        other, shift = (left, 0) if right is None else (right, len(left))
        for j in range(i if right is None else 0, len(other), SIDE):
            for x, y in zip(*(v.tolist() for v in _tally(a, other[j : j + SIDE], matches, radius))):
                x, y = root(i + x), root(shift + j + y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((x, y))
    return members[np.array(found, dtype=np.int64).reshape(-1, 2)]


def _first_met(a: np.ndarray, b: np.ndarray, numbers: np.ndarray | int, positions: np.ndarray) -> np.ndarray:
    """Of pairs of fingerprints that meet in lists of the sets ``numbers`` of positions, those that meet in no earlier set."""
    out = np.zeros(len(a), dtype=bool)
    numbers = np.broadcast_to(numbers, len(a))
    for k in range(0, len(a), CHUNK):
        same = (a[k : k + CHUNK] ^ b[k : k + CHUNK]).view(np.uint8).reshape(-1, 8 * a.shape[1]) == 0
        out[k : k + CHUNK] = same[:, positions].all(axis=2).argmax(axis=1) == numbers[k : k + CHUNK]
    return out


def _side_pairs(ids: np.ndarray, left: np.ndarray, other_ids: np.ndarray | None, right: np.ndarray | None, number: int, matches: int, radius: int, positions: np.ndarray) -> Iterator[np.ndarray]:
    """Every near pair within ``left`` (right None) or between the two that meets first in the set ``number``."""
    other, names = (left, ids) if right is None else (right, other_ids)
    for i in range(0, len(left), SIDE):
        for j in range(i if right is None else 0, len(other), SIDE):
            x, y = _tally(left[i : i + SIDE], other[j : j + SIDE], matches, radius)
            x, y = x + i, y + j
            if right is None:
                x, y = x[x < y], y[x < y]
            new = _first_met(left[x], other[y], number, positions)
            yield np.stack([ids[x[new]], names[y[new]]], axis=1)


def _run_pairs(sets: np.ndarray, ids: np.ndarray, fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, matches: int, radius: int, positions: np.ndarray) -> Iterator[np.ndarray]:
    """Every near pair within each run starts[i]:ends[i], in the first list only that holds both."""
    sizes = ends - starts
    for n in np.unique(sizes):
        at = starts[sizes == n]
        if n > 8:
            for k in at:
                yield from _side_pairs(ids[k : k + n], fps[k : k + n], None, None, int(sets[k]), matches, radius, positions)
            continue
        rows = at[:, None] + np.arange(n)
        for i, j in combinations(range(int(n)), 2):
            for k in range(0, len(rows), 1 << 16):
                x, y = rows[k : k + (1 << 16), i], rows[k : k + (1 << 16), j]
                differ = fps[x] ^ fps[y]
                near = np.bitwise_count(differ).sum(axis=1) <= radius
                x, y, differ = x[near], y[near], differ[near]
                near = (differ.view(np.uint8).reshape(-1, 8 * fps.shape[1]) == 0).sum(axis=1) >= matches
                x, y = x[near], y[near]
                new = _first_met(fps[x], fps[y], sets[x], positions)
                yield np.stack([ids[x[new]], ids[y[new]]], axis=1)


def _links_of(found: list[np.ndarray], longs: int) -> pa.RecordBatch:
    pairs = np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    n = len(pairs)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), none, none, pa.nulls(n, pa.int32()), *[none] * longs], names=["a", "b", "list", "bytes", "slice", *(f"fp{k}" for k in range(longs))])


def _positions(size: int, matches: int, chosen: int) -> list[tuple[int, ...]]:
    """Sets of ``chosen`` of ``size`` positions, of which any ``matches`` positions hold at least one."""
    if chosen == 1:  # of all positions but these, one at most is missing
        return [(i,) for i in range(size - matches + 1)]
    if (matches, chosen) == (4, 3):  # Turan's system: within a group, or two of a group and one of the next
        group = [i * 3 // size for i in range(size)]
        return [s for s in combinations(range(size), 3) if sorted((group[i] - group[s[0]]) % 3 for i in s) in ([0, 0, 0], [0, 0, 1], [0, 2, 2])]
    # the positions are dealt to as few groups as make `chosen` of them meet in one; the sets are those within a group
    groups = (matches - 1) // (chosen - 1)
    return [s for g in range(groups) for s in combinations(range(g, size, groups), chosen)]


def _byte(columns: list[str], at: int) -> Column:
    return F.shiftrightunsigned(F.col(columns[at // 8]), 8 * (at % 8)).bitwiseAND(F.lit(255).cast("long"))


def near_links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """a, b (a < b): links that join just those fingerprints that are at most ``radius`` bits apart, over any number of
    steps. ``prints``: one column of distinct longs without nulls."""
    if not 0 <= radius < 8:
        raise ValueError("a byte index needs a radius below 8")
    matches = 8 - radius
    fp = F.col(prints.columns[0])
    masks = [sum(0xFF << 8 * p for p in s) for s in _positions(8, matches, min(3, max(1, matches - 1)))]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    # a fingerprint with the other bytes blanked is the list's key, and itself the node
    entries = prints.select(F.posexplode(F.array(*[fp.bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("set", "bytes"), fp.alias("node"))
    return _links(entries.select(F.col("set").cast("byte").alias("set"), "bytes", "node"), [], matches, radius)


def wide_links(prints: DataFrame, matches: int, radius: int, chosen: int = 2) -> DataFrame:
    """a, b (a < b): all pairs of nodes whose fingerprints share at least ``matches`` positional bytes and are at most
    ``radius`` bits apart, each once. ``prints``: node and fp0, fp1, ..., without nulls."""
    columns = prints.columns[1:]
    keys = []
    sets = _positions(8 * len(columns), matches, chosen)
    for s in sets:
        key = _byte(columns, s[0])
        for at in s[1:]:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(columns, at))
        keys.append(key)
    entries = prints.select(F.posexplode(F.array(*keys)).alias("set", "bytes"), *prints.columns)
    return _links(entries.select(F.col("set").cast("short").alias("set"), F.col("bytes").cast("int").alias("bytes"), *prints.columns), columns, matches, radius, np.array(sets))


def _links(lists: DataFrame, columns: list[str], matches: int, radius: int, positions: np.ndarray | None = None) -> DataFrame:
    """Links from the lists' members (set, bytes, node, fingerprint; without columns of it the node is the fingerprint).

    Lists lie sorted in their partition and stream through its task in blocks of SIDE x SIDE pairs. A list gives a link
    only where that joins two groups not yet joined in it: less links than it has members, however many pairs are
    near. A list of more than SLICE members is cut into slices, and every two slices meet in a task of their own.
    With ``positions`` (those of each set), every near pair is given, by the first list that holds both.
    """
    longs = len(columns)
    most = SLICE if positions is None else SLICE_OF_PAIRS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the end of a batch may lie within a list: its last list waits for the next batch
        held: tuple[np.ndarray, ...] = (*(np.empty(0, np.int64) for _ in range(3)), np.empty((0, max(1, longs)), np.uint64))
        cut: dict[tuple[int, int], int] = {}

        def slices(s: int, key: int, ids: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            n = len(ids)
            first = cut.get((s, key), -1) + 1
            number = first + (np.arange(n) // most if positions is not None else np.zeros(n, np.int64))
            cut[s, key] = int(number[-1])
            own = [pa.array(fps[:, k].copy().view(np.int64)) for k in range(longs)]
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(n, pa.int64()), pa.array(np.full(n, s, np.int64)), pa.array(np.full(n, key, np.int64)), pa.array(number.astype(np.int32)), *own], names=["a", "b", "list", "bytes", "slice", *columns])

        def work(sets: np.ndarray, keys: np.ndarray, ids: np.ndarray, fps: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not len(ids):
                return
            new = np.flatnonzero((sets[1:] != sets[:-1]) | (keys[1:] != keys[:-1])) + 1
            starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(ids)]])
            if not last:
                k = starts[-1]
                held = (sets[k:], keys[k:], ids[k:], fps[k:])
                starts, ends = starts[:-1], ends[:-1]
            if len(starts) and cut:  # a list that was cut before ends here
                where = (int(sets[0]), int(keys[0]))
                if where in cut:
                    yield slices(*where, ids[: ends[0]], fps[: ends[0]])
                    starts, ends = starts[1:], ends[1:]
                cut.clear()
            several = ends - starts > 1
            if positions is None:
                yield _links_of(_join_runs(ids, fps, starts[several], ends[several], matches, radius), longs)
            else:
                found: list[np.ndarray] = []
                held_pairs = 0
                for pairs in _run_pairs(sets, ids, fps, starts[several], ends[several], matches, radius, positions):
                    found.append(pairs)
                    held_pairs += len(pairs)
                    if held_pairs >= HELD_PAIRS:
                        yield _links_of(found, longs)
                        found, held_pairs = [], 0
                yield _links_of(found, longs)
            if not last and len(held[2]) >= most:
                yield slices(int(held[0][0]), int(held[1][0]), held[2], held[3])
                held = tuple(x[:0] for x in held)

        for b in batches:
            s, key, ids = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
            fps = np.stack([b.column(3 + k).to_numpy(zero_copy_only=False) for k in range(longs)], axis=1) if longs else ids[:, None].copy()
            yield from work(*(np.concatenate([x, y]) for x, y in zip(held, (s, key, ids, fps.view(np.uint64)))), False)
        yield from work(*held, True)

    schema = "a long, b long, list long, bytes long, slice int" + "".join(f", {c} long" for c in columns)
    out = durable(lists.repartition("set", "bytes").sortWithinPartitions("set", "bytes").mapInArrow(scan, schema))
    links = out.where("slice is null").select("a", "b")
    parts = out.where("slice is not null")
    if parts.limit(1).count():
        links = links.unionAll(_slice_pairs(parts, columns, matches, radius, positions))
    return links


def _slice_pairs(parts: DataFrame, columns: list[str], matches: int, radius: int, positions: np.ndarray | None = None) -> DataFrame:
    """Links of lists that were cut: every two slices of a list (and each slice with itself) make a group."""
    last = parts.groupBy("list", "bytes").agg(F.max("slice").alias("last"))
    each = parts.join(last, ["list", "bytes"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    each = each.select("list", "bytes", "a", "slice", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), *columns)

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["a"].to_numpy()
        f = np.ascontiguousarray(pdf[columns or ["a"]].to_numpy(dtype=np.int64)).view(np.uint64)
        first = (pdf["slice"] == key[2]).to_numpy()
        sides = (ids, f, None, None) if key[2] == key[3] else (ids[first], f[first], ids[~first], f[~first])
        if positions is None:
            pairs = _join_sides(*sides, matches, radius)
        else:
            pairs = np.concatenate([np.empty((0, 2), np.int64), *_side_pairs(*sides, int(key[0]), matches, radius, positions)])
        pairs = np.sort(pairs, axis=1)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return each.groupBy("list", "bytes", "i", "j").applyInPandas(join, "a long, b long")


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long), component_id for each row of ``docs``.

    Texts whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest doc_id that is
    reachable over links, the row's own included. Null texts count as empty; texts without words have fingerprint 0,
    linked like any other. Rows with a null doc_id take part in links but give no component_id (null if no other row
    does). Repeated rows stay repeated. An empty table gives an empty result. Other columns are not read.
    """
    prints = durable(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], width))
    # one representative for all rows of one fingerprint
    each = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    linked = components(near_links(each.select("fp"), radius))
    member = linked.join(each.select(F.col("fp").alias("node"), "least"), "node")
    # a component is reduced by partial aggregation
    roots = durable(member.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = join_hot(member, roots, "root", roots.agg(F.sum("n")).first()[0] or 0).select(F.col("node").alias("fp"), "component_id")
    classes = durable(each.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total  # less than HOT fingerprints can have so large a share
    few = F.broadcast(classes.where(hot).select("fp", "component_id"))
    rest = prints.join(few.select("fp"), "fp", "left_anti").join(classes.where(~hot).select("fp", "component_id"), "fp")
    return prints.join(few, "fp").unionAll(rest).select("doc_id", "fp", "component_id")


#: Near copies: 5-word shingles, 256 bits, the least similarity, and what fingerprints of pairs that are compared must
#: share. At a similarity of 0.8, 39 bits differ on average, with a deviation of 6, and a byte is shared with a
#: probability of 0.27: 8.6 of 32, with a deviation of 2.5. The shared bytes asked for are two deviations below that.
WIDTH, LONGS, LEAST, MATCHES, RADIUS = 5, 4, 0.8, 4, 64


def near_classes(docs: DataFrame, least: float = LEAST, width: int = WIDTH, longs: int = LONGS, matches: int = MATCHES, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """prints (doc_id, n, d0, d1: size and digest of the set of shingles, for each row of ``docs``: doc_id, text), and
    classes (n, d0, d1, node, root): for each different set its number and the smallest of its group's numbers.

    Sets are linked if their similarity (Jaccard) is ``least`` or more, equal ones by their 128-bit digest. Fingerprints
    of the sets only say which pairs are compared: all that share ``matches`` bytes and differ in at most ``radius`` bits.
    """
    columns = [f"fp{k}" for k in range(longs)]
    prints = durable(_set_prints(docs, ["doc_id"], width, longs))
    # a set's number is its place in the table as it was written; ids may repeat, and several texts may have one id
    each = durable(prints.groupBy("n", "d0", "d1", *columns).agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id()))
    near = wide_links(each.where("n > 1").select("node", *columns), matches, radius)
    # sizes alone tell of many pairs that they are less similar
    size = each.select("node", "n")
    near = near.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9).select("a", "b")
    near = durable(near.distinct())
    # the sets themselves, of one row each
    wanted = near.select("a").unionAll(near.select("b")).distinct().toDF("node").join(each, "node").select("doc_id", "n", "d0", "d1", "node")
    sets = _set_hashes(docs.join(wanted.select("doc_id"), "doc_id", "left_semi"), ["doc_id"], width)
    sets = durable(sets.join(wanted, ["doc_id", "n", "d0", "d1"]).dropDuplicates(["node"]).select("node", "hashes"))
    both = near.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    linked = both.where(shared >= (F.size("ha") + F.size("hb") - shared) * least - 1e-9).select("a", "b")
    classes = each.join(components(linked), "node", "left").select("n", "d0", "d1", "doc_id", "node", F.coalesce("root", "node").alias("root"))
    return prints, durable(classes)


def keep_one(docs: DataFrame, least: float = LEAST, width: int = WIDTH, longs: int = LONGS, matches: int = MATCHES, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group of near_classes() a row with the smallest id stays.

    Rows with a null id stay, as nothing can name them, and link nothing. Null texts count as empty; texts without words
    are copies of each other. Ids may repeat, and one id may have several texts: just one row of each group stays. All
    columns come back as they are. An empty table gives an empty result.
    """
    columns = docs.columns
    named = docs.where(F.col(id_col).isNotNull())
    prints, classes = near_classes(named.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), least, width, longs, matches, radius)
    # of each group the set with the smallest id, then with the smallest number
    best = classes.groupBy("root").agg(F.min(F.struct("doc_id", "node", "n", "d0", "d1")).alias("x")).select("x.doc_id", "x.n", "x.d0", "x.d1")
    best = durable(best)
    repeated = durable(prints.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    own = [f"c{i}" for i in range(len(columns))]
    at, text = own[columns.index(id_col)], own[columns.index(text_col)]
    stay = named.toDF(*own).join(best.select(F.col("doc_id").alias("_id")), F.col(at) == F.col("_id"), "left_semi")
    if repeated.limit(1).count():
        # where ids repeat, the text tells which row is meant
        twice = F.col(at) == F.col("_id")
        many = repeated.select(F.col("doc_id").alias("_id"))
        found = _set_prints(stay.join(many, twice, "left_semi"), own, width, longs, text).join(best.select(F.col("doc_id").alias("_id"), F.col("n").alias("_n"), F.col("d0").alias("_d0"), F.col("d1").alias("_d1")), twice & F.col("n").eqNullSafe(F.col("_n")) & (F.col("d0") == F.col("_d0")) & (F.col("d1") == F.col("_d1")))
        stay = stay.join(many, twice, "left_anti").unionAll(found.dropDuplicates([at, "n", "d0", "d1"]).select(*own))
    return stay.unionAll(docs.where(F.col(id_col).isNull()).toDF(*own)).toDF(*columns)
