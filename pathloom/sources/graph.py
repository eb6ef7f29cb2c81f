"""Property graphs as typed tables of vertices and edges, one for each set of labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.lang.errors import BindError

#: Ids of mapped tables: the table's number above this many bits, the key below.
KEY_BITS = 48


@dataclass
class ElementTable:
    """Elements with one set of labels. ``df`` has id, and for edges src and dst; the other columns are in ``props``,
    which maps a property's lower-cased name to its column. ``source``/``target``: labels of the end points' tables, None
    where edges may join any vertices. Where an edge's id is None, it is made when a query asks for it."""

    labels: tuple[str, ...]
    df: DataFrame
    props: dict[str, str]
    source: str | None = None
    target: str | None = None
    id_made: bool = False

    def type_of(self, prop: str):
        return self.df.schema[self.props[prop]].dataType

    def has(self, labels: Sequence[str]) -> bool:
        own = {x.lower() for x in self.labels}
        return any(x.lower() in own for x in labels)


@dataclass
class PropertyGraph:
    """``sound``: edges' end points are known to exist, so that vertices of which nothing is asked need no scan."""

    name: str
    vertices: list[ElementTable] = field(default_factory=list)
    edges: list[ElementTable] = field(default_factory=list)
    sound: bool = False
    extra_labels: set[str] = field(default_factory=set)

    @property
    def labels(self) -> list[str]:
        return sorted({x for t in [*self.vertices, *self.edges] for x in t.labels} | self.extra_labels)

    def knows(self, label: str) -> bool:
        return label.lower() in {x.lower() for x in self.labels}

    # building from DataFrames
    def add_vertices(self, label: str, df: DataFrame, key: str | Column, props: Mapping[str, str] | Sequence[str] | None = None) -> PropertyGraph:
        """Rows of ``df`` as vertices; ``key``: an integer column, unique in the table, from 0 to 2^48. ``props``: the
        columns that are properties (all, unless given), or their names by column."""
        number = len(self.vertices) + 1
        value = F.col(key) if isinstance(key, str) else key
        columns = self._props(df, props)
        out = df.select((_in_range(value) + F.lit(number << KEY_BITS)).alias("id"), *[F.col(c).alias(p) for c, p in columns])
        self.vertices.append(ElementTable((label,), out, {p.lower(): p for _, p in columns}))
        return self

    def add_edges(self, label: str, df: DataFrame, source: tuple[str, str | Column], target: tuple[str, str | Column], key: str | Column | None = None, props: Mapping[str, str] | Sequence[str] | None = None) -> PropertyGraph:
        """Rows of ``df`` as edges; ``source`` and ``target``: label of the end point's table and its key. Rows with a
        null key join nothing. Without ``key`` an edge's id is its place in the table."""
        number = len(self.edges) + 1

        def end(at: tuple[str, str | Column]) -> Column:
            value = F.col(at[1]) if isinstance(at[1], str) else at[1]
            return _in_range(value) + F.lit(self._number(at[0]) << KEY_BITS)

        columns = self._props(df, props)
        own = None if key is None else ((F.col(key) if isinstance(key, str) else key).cast("long") + F.lit(number << KEY_BITS)).alias("id")
        out = df.select(*([own] if own is not None else []), end(source).alias("src"), end(target).alias("dst"), *[F.col(c).alias(p) for c, p in columns])
        self.edges.append(ElementTable((label,), out, {p.lower(): p for _, p in columns}, source[0], target[0], own is None))
        return self

    def _number(self, label: str) -> int:
        for i, t in enumerate(self.vertices):
            if t.has([label]):
                return i + 1
        raise BindError(f"label {label}: label not exists")

    @staticmethod
    def _props(df: DataFrame, props: Mapping[str, str] | Sequence[str] | None) -> list[tuple[str, str]]:
        if props is None:
            props = df.columns
        pairs = list(props.items()) if isinstance(props, Mapping) else [(c, c) for c in props]
        clash = {"id", "src", "dst"} & {p.lower() for _, p in pairs}
        if clash:
            raise BindError(f"properties {sorted(clash)} have names of the graph's own; rename them")
        return pairs


def _in_range(key: Column) -> Column:
    """An integer key from 0 to 2^48, else an error; null stays null."""
    value = key.cast("long")
    return F.when(value.isNull() | value.between(0, (1 << KEY_BITS) - 1), value).otherwise(F.raise_error(F.lit("a key is not between 0 and 2^48")).cast("long"))


def edge_id(t: ElementTable, number: int) -> Column:
    """The id column of an edge table; a row's place where the table has no key."""
    return F.col("id") if not t.id_made else F.monotonically_increasing_id() + F.lit(number << 56)
