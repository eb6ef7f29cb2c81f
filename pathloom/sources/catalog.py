"""Graphs that the library stores: Parquet files under a warehouse folder, one manifest a graph.

A manifest lists, for each set of labels, the files' folders and their properties; it also has the labels, properties
and indexes, and the next ids. Data folders are never changed: a statement writes new ones and publishes a new manifest
by renaming it into place, so readers see one snapshot, and a statement takes effect whole or not at all.
"""

from __future__ import annotations

import copy
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.lang.errors import CatalogError
from pathloom.sources.graph import ElementTable, PropertyGraph


def _key(labels: list[str] | tuple[str, ...]) -> tuple[str, ...]:
    return tuple(sorted(x.lower() for x in labels))


class StoredGraph:
    """A manifest and what it means; changes are made on a copy and published together."""

    def __init__(self, name: str, data: dict | None = None):
        self.name = name
        self.data = data or {"labels": {}, "properties": {}, "indexes": {}, "vertices": [], "edges": [], "next_vertex": 1, "next_edge": 1, "version": 0}

    def copy(self) -> StoredGraph:
        return StoredGraph(self.name, copy.deepcopy(self.data))

    def label(self, name: str) -> str:
        try:
            return self.data["labels"][name.lower()]
        except KeyError:
            raise CatalogError(f"label {name}: label not exists") from None

    def table(self, kind: str, labels: list[str]) -> dict:
        """The entry of a set of labels, made if it is new."""
        for t in self.data[kind]:
            if _key(t["labels"]) == _key(labels):
                return t
        self.data[kind].append({"labels": [self.label(x) for x in labels], "parts": [], "props": {}})
        return self.data[kind][-1]

    def graph(self, spark: SparkSession) -> PropertyGraph:
        """The graph as tables. Labels that have been dropped are no longer seen."""
        g = PropertyGraph(self.name, sound=True, extra_labels=set(self.data["labels"].values()))
        for kind in ("vertices", "edges"):
            for t in self.data[kind]:
                if t["parts"]:
                    labels = tuple(x for x in t["labels"] if x.lower() in self.data["labels"])
                    getattr(g, kind).append(ElementTable(labels, self.read(spark, t, kind), {p: p_name(t, p) for p in t["props"]}))
        return g

    def read(self, spark: SparkSession, t: dict, kind: str) -> DataFrame:
        own = "id long" if kind == "vertices" else "id long, src long, dst long"
        schema = T.StructType([*T.StructType.fromDDL(own).fields, *(T.StructField(v["name"], T._parse_datatype_json_string(v["type"])) for v in t["props"].values())])
        return spark.read.schema(schema).parquet(*t["parts"])


def p_name(t: dict, p: str) -> str:
    return t["props"][p]["name"]


class Warehouse:
    """The stored graphs of a folder. One process writes to it at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))
        self._jvm = jvm
        self.graphs: dict[str, StoredGraph] = {}
        for s in self._fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if name.endswith(".json"):
                d = json.loads(self._text(s.getPath()))
                self.graphs[d["name"].lower()] = StoredGraph(d["name"], d["data"])

    def _text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _file(self, name: str) -> str:
        return f"{self.path}/{name.lower().encode().hex()}.json"

    def publish(self, g: StoredGraph) -> None:
        g.data["version"] += 1
        temporary, final = self._path(f"{self._file(g.name)}.{uuid.uuid4().hex}.new"), self._path(self._file(g.name))
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(json.dumps({"name": g.name, "data": g.data}).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(final), options)
        self.graphs[g.name.lower()] = g

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(self._file(name)), False)
        self._fs.delete(self._path(self.folder(name)), True)
        del self.graphs[name.lower()]

    def folder(self, name: str) -> str:
        return f"{self.path}/{name.lower().encode().hex()}"

    def write(self, g: StoredGraph, df: DataFrame) -> str:
        """A new data folder."""
        path = f"{self.folder(g.name)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path


def widen(old: T.DataType, new: T.DataType, prop: str) -> T.DataType:
    """The stored type of a property that gets values of another type: Int < Float < Decimal; nothing else mixes."""
    from pathloom.functions.expressions import NUMBERS, kind_of

    if old == new or isinstance(new, T.NullType):
        return old
    if isinstance(old, T.NullType):
        return new
    a, b = kind_of(old), kind_of(new)
    if a in NUMBERS and b in NUMBERS:
        return {"int": T.LongType(), "float": T.DoubleType(), "decimal": T.DecimalType(38, 12)}[max(a, b, key=NUMBERS.index)]
    if a == b:
        return old if a != "decimal" else T.DecimalType(38, 12)
    raise CatalogError(f"property {prop} holds {a}, not {b}")


def store(w: Warehouse, g: StoredGraph, kind: str, labels: list[str], df: DataFrame, replace: bool = False) -> None:
    """Adds the rows of ``df`` (id, (src, dst,) properties) to the table of these labels, or puts them in its place."""
    t = g.table(kind, labels)
    own = 1 if kind == "vertices" else 3
    rewrite = False
    if replace:
        t["props"] = {}
    for f in df.schema.fields[own:]:
        p = f.name.lower()
        known = g.data["properties"].setdefault(p, f.name)
        if p in t["props"]:
            old = T._parse_datatype_json_string(t["props"][p]["type"])
            new = widen(old, f.dataType, known)
            rewrite |= new != old and not isinstance(old, T.NullType)
        else:
            new = f.dataType
        t["props"][p] = {"name": t["props"].get(p, {}).get("name", f.name), "type": new.json()}
    columns = []
    for p, v in t["props"].items():
        kind_ = T._parse_datatype_json_string(v["type"])
        here = next((f.name for f in df.schema.fields[own:] if f.name.lower() == p), None)
        if isinstance(kind_, T.NullType):
            v["type"] = T.StringType().json()
            kind_ = T.StringType()
        columns.append((F.col(f"`{here}`") if here else F.lit(None)).cast(kind_).alias(v["name"]))
    out = df.select(*df.columns[:own], *columns)
    if rewrite and t["parts"] and not replace:
        # a wider type: the parts that are there are written anew
        old = w.spark.read.option("mergeSchema", "true").parquet(*t["parts"])
        for v in t["props"].values():
            if v["name"] not in old.columns:
                old = old.withColumn(v["name"], F.lit(None))
        old = old.select(*df.columns[:own], *[F.col(f"`{v['name']}`").cast(T._parse_datatype_json_string(v["type"])).alias(v["name"]) for v in t["props"].values()])
        t["parts"] = [w.write(g, old)]
    part = w.write(g, out)
    t["parts"] = [part] if replace else [*t["parts"], part]
