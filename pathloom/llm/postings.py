"""Per-document token frequencies as an inverted index in blocks, and sums over them of a value of each token.

A block is some consecutive documents of a task; for each distinct token of a block the index has one row that packs
(document within the block, frequency). So a token's value is joined once a block, not once an occurrence, and no
document's tokens are ever listed. The index is shuffled once and never stored; sums go back to documents block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from pathloom.llm._common import durable, text_of

#: Documents (a power of two) and characters of a block, where a text may go beyond the latter: both bound memory. An
#: entry has 16 bits, of which the upper ones are a frequency less 1; higher frequencies take several entries.
BITS, CHARS = 14, 16_000_000
#: Bytes of entries from which a token's rows are salted, and the number of salts.
LONG, SALTS = 512, 256

#: Distinct tokens of some texts; of pairs of token and text (which may repeat) the token's number, the text's and the
#: frequency; and what each text has besides.
Split = Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[int]]]


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def packed(token: np.ndarray, text: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries (frequency, document) by token, and where each token's begin."""
    key = (token.astype(np.int64) << BITS) | text
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    if len(first) < len(key):
        key, n = key[first], np.add.reduceat(n, first)
    most = 1 << 16 - BITS
    times = -(-n // most)
    key, rest = np.repeat(key, times), n - (times - 1) * most
    n = np.full(len(key), most, np.uint16)
    n[np.cumsum(times) - 1] = rest
    starts = np.flatnonzero(np.diff(key >> BITS, prepend=-1))
    return (n - 1 << BITS | key & (1 << BITS) - 1).astype("<u2"), starts


def postings(docs: DataFrame, keys: list[str], split: Callable[[], Split], text_col: str = "text") -> DataFrame:
    """block, token, posts; and a row for each block with a null token, whose posts are its documents' ``keys`` and
    _besides, as a stream of Arrow's. A null text counts as empty. What is a block must not change when a lost task is run
    again, so documents that come out of a shuffle, in any order, are written to the shared folder first."""
    docs = docs.select(*keys, text_of(docs, text_col).alias("_text"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = durable(docs)
    names = ["block", "token", "posts"]
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, number = split(), TaskContext.get().partitionId() << 32
        texts: list[str] = []
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            tokens, *pairs, besides = own(texts)
            entries, starts = packed(*pairs)
            offsets = np.append(starts, len(entries)).astype(np.int32) * 2
            posts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), number, np.int64)), pa.array(tokens, pa.string()), posts], names=names)
            columns = [*(pa.concat_arrays([h.column(i) for h in held]) for i in range(n_keys)), pa.array(besides, pa.int64())]
            rows = pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(n_keys + 1)])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=names)
            number, size = number + 1, 0
            texts.clear(), held.clear()

        for b in batches:
            begin = 0
            for i, t in enumerate(b.column(n_keys).to_pylist()):
                if texts and (len(texts) == 1 << BITS or size + len(t) > CHARS):
                    if i > begin:
                        held.append(b.slice(begin, i - begin))
                        begin = i
                    yield from flush()
                texts.append(t)
                size += len(t)
            if b.num_rows > begin:
                held.append(b.slice(begin))
        if texts:
            yield from flush()

    return docs.mapInArrow(run, "block long, token string, posts binary")


def sums(index: DataFrame, head: StructType, values: Callable[[], Callable[[list[str]], list[int]]]) -> DataFrame:
    """The key columns (of the schema ``head``), _besides and _sum for each document: the sum of frequency times value over
    its tokens.

    ``values`` gives a function from distinct tokens to their values. All rows of a token meet in one task, in order, so
    that it is valued once and joined to all of them; only tokens of many documents are salted by block, and valued once
    a salt. Sums are exact up to 2^53.
    """
    salt = F.when(F.col("token").isNull(), F.col("block")).when(F.octet_length("posts") > LONG, F.col("block") % SALTS).otherwise(0)

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, last, known = values(), None, 0
        for b in batches:
            coded = b.column(1).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            # the first token of a batch may be the last of the one before
            found = np.array([known, *value(distinct[1:])] if distinct and distinct[0] == last else value(distinct), dtype=np.int64)
            if distinct:
                last, known = distinct[-1], int(found[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found).take(coded.indices)], names=["block", "posts", "value"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(1 << BITS)

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            part = total[at].astype("<i8")
            if not len(part) or np.abs(part).max() < 1 << 31:
                part = part.astype("<i4")
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([at.astype("<u2").tobytes()]), pa.array([part.tobytes()])], names=["block", "at", "part"])

        for b in batches:
            if b.column(2).null_count:  # documents' keys
                whole = b.filter(b.column(2).is_null())
                yield pa.RecordBatch.from_arrays([whole.column(0), pa.nulls(whole.num_rows, pa.binary()), whole.column(1).cast(pa.binary())], names=["block", "at", "part"])
                b = b.filter(b.column(2).is_valid())
            if not b.num_rows:
                continue
            blocks = b.column(0).to_numpy()
            value = b.column(2).to_numpy().astype(np.float64)
            posts = b.column(1)
            if isinstance(posts, pa.LargeBinaryArray):
                posts = posts.cast(pa.binary())
            offsets = np.frombuffer(posts.buffers()[1], np.int32)[posts.offset : posts.offset + len(posts) + 1] // 2
            entries = np.frombuffer(posts.buffers()[2] or b"", "<u2")
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
                if blocks[i] != block:
                    if block is not None:
                        yield out()
                    block, total = int(blocks[i]), np.zeros(1 << BITS)
                own = entries[offsets[i] : offsets[j]]
                weights = np.repeat(value[i:j], np.diff(offsets[i : j + 1])) * ((own >> BITS) + 1)
                total += np.bincount(own & (1 << BITS) - 1, weights=weights, minlength=1 << BITS)
        if block is not None:
            yield out()

    joined = index.repartition("token", salt).sortWithinPartitions("token").mapInArrow(valued, "block long, posts binary, value long")
    parts = joined.sortWithinPartitions("block").mapInArrow(partial, "block long, at binary, part binary")
    schema = StructType([*head.fields, StructField("_besides", LongType()), StructField("_sum", LongType())])
    arrow = to_arrow_schema(schema)

    def whole(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << BITS, np.int64)
        for at, part in zip(table.column("at").to_pylist(), table.column("part").to_pylist()):
            if at is None:
                docs = pa.ipc.open_stream(part).read_all()
            else:
                at = np.frombuffer(at, "<u2")
                total[at] += np.frombuffer(part, "<i8" if len(part) == 8 * len(at) else "<i4")
        columns = [*docs.columns, pa.chunked_array([pa.array(total[: docs.num_rows])])]
        return pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types)], names=schema.names)

    return parts.groupBy("block").applyInArrow(whole, schema)
