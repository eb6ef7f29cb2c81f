"""Shared pieces of the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pathloom.plans.durable import discard, durable, shared_dir  # noqa: F401 - the operators' own

# Workers need not have this repository on their path: the functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

class Shipped:
    """A broadcast of an object whose class the workers need not be able to import. Its size is the caller's to bound."""

    def __init__(self, spark: SparkSession, value):
        self.bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load(self):
        """The object, on a worker; to be kept for the task."""
        return cloudpickle.loads(self.bytes.value)


def memo(name: str) -> types.ModuleType:
    """A place of this Python process that outlives a task; what is kept there must be bounded by its user."""
    return sys.modules.setdefault(f"_pathloom_{name}", types.ModuleType(name))


def text_of(df: DataFrame, column: str = "text"):
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def mapped(text: Column, begin: Callable[[], Callable[[list[str]], list]], kind: str) -> Column:
    """What the function that ``begin`` gives makes of texts, at most 512 at a time. Only the text goes to Python, and only
    the result comes back. A null text is an empty one."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = begin()
        for b in batches:
            parts = [fn(b.slice(i, 512).to_pylist()) for i in range(0, len(b), 512)]
            yield pa.array([x for part in parts for x in part], types[kind])

    types = {"double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(F.coalesce(text.cast("string"), F.lit("")))


def map_rows(df: DataFrame, keep: list[str], column: str, fn: Callable[[Iterator[list]], Iterator[dict]], schema: str) -> DataFrame:
    """Runs ``fn`` over lists of at most 512 values of ``column``; what it gives for each list (a dict of columns, one
    value a row) is put beside the columns ``keep``. Only these columns reach Python; texts are not returned. A null
    text is an empty one."""
    head = df.select(*keep).schema
    source = df.select(*keep, text_of(df, column).alias("_text"))
    n = len(keep)
    added = StructType.fromDDL(schema)
    types = list(to_arrow_schema(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 512):
                    yield b.slice(i, 512)

        waiting: list[pa.RecordBatch] = []

        def texts() -> Iterator[list]:
            for part in parts():
                waiting.append(part)
                yield part.column(n).to_pylist()

        for out in fn(texts()):
            part = waiting.pop(0)
            yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array(out[f.name], f.type) for f in types)], names=[*part.schema.names[:n], *(f.name for f in types)])

    return source.mapInArrow(run, StructType([*head.fields, *added.fields]))
