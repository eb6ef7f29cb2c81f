"""Best-fit packing of tokenized documents into sequences of a fixed length, by best-two-fit.

A bin is filled greedily with the longest unpacked document that still fits. While a gap remains, the bin's smallest
document is taken out if two unpacked documents fill its place more tightly. Bins depend only on lengths, so the plan
is made on the histogram of lengths (at most ``capacity`` classes, whatever the number of documents): one step plans
all bins of the same make-up. Documents then take the places planned for their length by their rank among documents
of that length; ranks come from per-partition counts, so that no length, however common, meets in one task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm._common import durable, memo, text_of
from pathloom.llm.token_counts import SPACE

#: Distinct words whose ids a worker remembers.
KNOWN = 600_000


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths in order of place, number of such bins); every document of the histogram has one place."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        count[length] += n
    plan: list[tuple[list[int], int]] = []

    def largest(limit: int, used: Counter) -> int:
        """The longest document of at most ``limit`` tokens that the bin has not used up."""
        at = limit
        while at > 0:
            found = np.flatnonzero(count[1 : at + 1])
            if not len(found):
                return 0
            at = int(found[-1]) + 1
            if count[at] > used[at]:
                return at
            at -= 1
        return 0

    while count[1:].any():
        used: Counter = Counter()
        gap = capacity
        while gap and (x := largest(gap, used)):
            times = min(gap // x, int(count[x]) - used[x])
            used[x] += times
            gap -= x * times
        peak = used.copy()
        while gap:  # the smallest gives way to the pair that leaves the least room
            small = min(used)
            room = gap + small
            free = count.copy()
            for x, n in used.items():
                free[x] -= n
            there = np.flatnonzero(free[1:room]) + 1
            if not len(there):
                break
            # for each a, the longest b <= room - a; a class with one document is no pair with itself
            b = np.searchsorted(there, room - there, side="right") - 1
            partner = np.where(b >= 0, there[np.maximum(b, 0)], 0)
            alone = (partner == there) & (free[there] < 2)
            partner = np.where(alone, np.where(b >= 1, there[np.maximum(b - 1, 0)], 0), partner)
            total = np.where(partner > 0, there + partner, 0)
            best = int(total.argmax())
            if total[best] <= small:
                break
            used[small] -= 1
            if not used[small]:
                del used[small]
            used[int(there[best])] += 1
            used[int(partner[best])] += 1
            peak |= used
            gap = room - int(total[best])
        # the same choices again for as long as all documents that were tried on the way are there
        times = 1 + min((int(count[x]) - peak[x]) // n for x, n in used.items())
        for x, n in used.items():
            count[x] -= n * times
        plan.append(([x for x, n in sorted(used.items(), reverse=True) for _ in range(n)], times))
    return plan


def places(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first bin, offset): rank r of a length lies in bin first bin + r - first rank."""
    rank: Counter = Counter()
    rows, bins = [], 0
    for lengths, times in plan:
        offset = 0
        for x in lengths:
            rows.append((x, rank[x], times, bins, offset))
            rank[x] += times
            offset += x
        bins += times
    return rows


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Lengths lie between 1 and ``capacity`` (others raise an error: cut them first). Rows with a null length get null.
    Equal lengths are interchangeable; repeated rows are separate pieces. An empty table gives an empty result. Columns
    that are called sequence_id or offset already are replaced; other names, whatever they are, stay.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    fields = [pieces.schema[c] for c in names]
    own = [f"c{i}" for i in range(len(names))]  # no name of the caller's clashes with those below
    renamed = pieces.select(*names).toDF(*own)
    length = F.col(own[names.index(length_col)]).cast("long")
    # the partition number and the order in it are data from here on: a second run can't change them
    kept = durable(renamed.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    counts = kept.where(length.isNotNull()).groupBy(length.alias("_length"), "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = durable(counts)
    # at most `capacity` rows
    histogram = {r[0]: r[1] for r in counts.groupBy("_length").agg(F.sum("_n")).limit(capacity + 2).collect()}
    if any(not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"a length is not between 1 and {capacity}")
    rows = places(best_two_fit(histogram, capacity))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = (
        kept.withColumn("_length", length)
        .withColumn("_local", F.row_number().over(Window.partitionBy("_part", "_length").orderBy("_row")) - 1)
        .join(before.hint("merge"), ["_part", "_length"], "left")  # counts grow with the partitions: never broadcast
        .withColumn("_rank", F.col("_before") + F.col("_local"))
    )
    # the plan's runs of one length are consecutive, so its index of the run comes from a sorted list per length
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for x, first, times, bin_, offset in rows:
        runs.setdefault(x, []).append((first, bin_, offset))
    # bounded by the capacity: each make-up leaves less of a length than it tries, so runs don't grow with the documents
    arrays = {x: tuple(np.array([r[i] for r in v], dtype=np.int64) for i in range(3)) for x, v in runs.items()}

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(b.num_columns - 2).to_numpy(zero_copy_only=False)
            ranks = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            seq, off = np.full(b.num_rows, -1), np.full(b.num_rows, -1)
            known = ~np.isnan(lengths.astype(float))
            for x in np.unique(lengths[known]):
                first, bin_, offset = arrays[int(x)]
                at = np.flatnonzero(known & (lengths == x))
                r = ranks[at].astype(np.int64)
                k = np.searchsorted(first, r, side="right") - 1
                seq[at], off[at] = bin_[k] + r - first[k], offset[k]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], pa.array(seq, mask=~known), pa.array(off, mask=~known)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*own, "_length", "_rank").mapInArrow(put, StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Letters and signs on which no two versions of Unicode differ; no white space, no controls.
LATIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u0148\u014a-\u017e]*").fullmatch


def word_ranks(path: str):
    """A rank table that gives the same ids as the file's BPE with word ends, and the id of a blank; None unless the
    file has exactly the form for which that holds. NUL stands for the word end: "x NUL" ranks before all merges."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    m, vocab = j["model"], j["model"]["vocab"]
    if [x.get("type") for x in (j.get("normalizer") or {}).get("normalizers") or []] != ["NFC", "Replace", "Lowercase"]:
        return None
    if m.get("type") != "BPE" or m.get("end_of_word_suffix") != "</w>" or any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return None
    split, *rest = (j.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    if split.get("pattern") != {"Regex": SPLIT} or split.get("behavior") != "Removed" or not split.get("invert") or [x.get("type") for x in rest] != ["ByteLevel"] or rest[0].get("use_regex") or rest[0].get("add_prefix_space"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = dict(zip(map(chr, shown), shown)) | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    merges = [x.split(" ") if isinstance(x, str) else x for x in m["merges"]]
    if any(vocab.get(a + b) != 512 + i for i, (a, b) in enumerate(merges)) or any(vocab.get(c, 256) > 255 or not 256 <= vocab.get(c + "</w>", 0) < 512 for c in byte):
        return None
    ranks = {}
    for piece, i in vocab.items():
        stem = piece.removesuffix("</w>") if i >= 256 else piece
        if any(c not in byte for c in stem):
            continue  # an added token
        ranks[bytes(byte[c] for c in stem) + (b"\0" if stem != piece else b"")] = i
    return tiktoken.Encoding("words", pat_str=" |[^\\x00 ]+\\x00", mergeable_ranks=ranks, special_tokens={}), vocab[next(c for c, b in byte.items() if b == 32)]


class WordIds:
    """Ids of a tokenizer that drops white space and lets no pre-token cross it: word by word, each distinct word once."""

    def __init__(self, path: str, known: int = KNOWN):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.normalizer, self.pre, self.model = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.words = re.compile(f"[^{SPACE}]+").findall
        self.mark = regex.compile(SPLIT).sub
        self.ranked = word_ranks(path)
        self.known, self.ids = known, {}

    def word(self, w: str) -> bytes:
        text = self.normalizer.normalize_str(w) if self.normalizer else w
        found = [t.id for piece, _ in self.pre.pre_tokenize_str(text) for t in self.model.tokenize(piece)]
        return np.array(found, dtype="<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Keeps the ids of words met for the first time; all in one call where the ranks allow, which is where Unicode
        tables of any version agree on letters and forms. Other words go to the library, as their classes may differ."""
        if len(self.ids) + len(new) > self.known:
            self.ids.clear()
        if self.ranked and new:
            sure = new if LATIN("".join(new)) else [w for w in new if LATIN(w)]
            encoding, blank = self.ranked
            # composed already, and lower case goes letter by letter
            text = " ".join([w + "\0" if w.isalpha() else self.mark("\\g<0>\0", w) for w in " ".join(sure).lower().split(" ")])
            flat = np.array(encoding.encode_ordinary(text), dtype="<u4")
            cuts = np.flatnonzero(flat == blank)
            if sure and len(cuts) == len(sure) - 1:
                raw, ends = flat.tobytes(), [*(4 * cuts).tolist(), 4 * len(flat)]
                begin = 0
                for w, e in zip(sure, ends):
                    self.ids[w] = raw[begin:e]
                    begin = e + 4
        for w in new:
            if w not in self.ids:
                self.ids[w] = self.word(w)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.added and self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text  # split() alone takes these for blanks
        words = self.words(text) if odd else text.split()
        for _ in range(2):  # twice, as learning may drop older words
            if new := set(words).difference(self.ids):
                self.learn(list(new))
        try:
            return b"".join(map(self.ids.__getitem__, words))
        except KeyError:  # more distinct words than are kept
            return b"".join(map(self.word, words))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Keys, piece, start, length, ids_crc32 (and ids, as bytes): each document's ids and an end id, cut at ``capacity``.

    A null text is an empty one (its only id is the end id). Repeated rows are separate documents. Nulls in keys stay.
    """
    from pyspark.sql.types import StructType

    source = docs.select(*keys, text_of(docs, text_col).alias("_text"))
    n = len(keys)
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = memo("words")
        if getattr(place, "path", None) != tokenizer:
            place.encoder, place.path = WordIds(tokenizer), tokenizer
        encoder, end = place.encoder, np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                at, piece, start, length, crc, kept = [], [], [], [], [], []
                for k, text in enumerate(b.column(n).to_pylist()):
                    ids = encoder.encode(text) + end
                    for p, s in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        at.append(k), piece.append(p), start.append(s // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(part)
                take = pa.array(at, pa.int64())
                columns = [pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc)), *([pa.array(kept, pa.binary())] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns[:n]), *columns], names=[*b.schema.names[:n], *names])

    schema = StructType([*docs.select(*keys).schema.fields, *StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids).fields])
    return source.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """All documents tokenized, cut only where longer than ``capacity``, and packed into few sequences (see pack())."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id, with_ids, keys, text_col), capacity)
