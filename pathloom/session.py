"""Sessions: statements in, DataFrames out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.lang import ast as A
from pathloom.lang.errors import BindError, CatalogError, GraphError
from pathloom.lang.parser import parse
from pathloom.operators.modify import Modifier, numbered
from pathloom.operators.select import Selector
from pathloom.plans.durable import shared_dir
from pathloom.sources.catalog import StoredGraph, Warehouse, store
from pathloom.sources.graph import PropertyGraph


class Session:
    """Statements over mapped graphs (register()) and stored ones (CREATE GRAPH), which lie in ``warehouse``.

    Spark runs with ANSI errors and the TIME type on, as the language asks for both; the session sets them.
    """

    def __init__(self, spark: SparkSession, warehouse: str | Warehouse | None = None):
        self.spark = spark
        for k, v in (("spark.sql.timeType.enabled", "true"), ("spark.sql.ansi.enabled", "true")):
            spark.conf.set(k, v)
        self._warehouse = warehouse
        self.mapped: dict[str, PropertyGraph] = {}
        self.current: str | None = None
        self.staged: dict[str, StoredGraph] | None = None

    @property
    def warehouse(self) -> Warehouse:
        if not isinstance(self._warehouse, Warehouse):
            self._warehouse = Warehouse(self.spark, self._warehouse or f"{shared_dir(self.spark)}/warehouse-{uuid.uuid4().hex}")
        return self._warehouse

    def _has_store(self) -> bool:
        return self._warehouse is not None

    # graphs
    def register(self, graph: PropertyGraph, use: bool = True) -> Session:
        """Makes a mapped graph known under its name."""
        self.mapped[graph.name.lower()] = graph
        if use:
            self.current = graph.name
        return self

    def stored(self, name: str) -> StoredGraph | None:
        if self.staged and name.lower() in self.staged:
            return self.staged[name.lower()]
        return self.warehouse.graphs.get(name.lower()) if self._has_store() else None

    def graph(self, name: str | None = None) -> PropertyGraph:
        name = name if name is not None else self.current
        if name is None:
            raise CatalogError("no graph selected")
        if name.lower() in self.mapped:
            return self.mapped[name.lower()]
        g = self.stored(name)
        if g is None:
            raise CatalogError(f"graph {name}: graph not exists")
        key = (g.name.lower(), id(g), g.data["version"])
        if getattr(self, "_cached", (None,))[0] != key:
            self._cached = (key, g.graph(self.spark))
        return self._cached[1]

    def import_graph(self, name: str, source: PropertyGraph) -> None:
        """A stored copy of a graph. Vertices keep their ids; edges are numbered."""
        if self._find(name):
            raise CatalogError(f"graph {name}: graph exists")
        g = StoredGraph(name)
        for x in source.labels:
            g.data["labels"][x.lower()] = x
        for kind in ("vertices", "edges"):
            for t in getattr(source, kind):
                props = [F.col(f"`{c}`") for c in t.props.values()]
                if kind == "vertices":
                    df = t.df.select("id", *props)
                    top = df.agg(F.max("id")).first()[0]
                    g.data["next_vertex"] = max(g.data["next_vertex"], (top or 0) + 1)
                else:
                    df, n = numbered(t.df.select("src", "dst", *props))
                    df = df.select((F.col("_n") + g.data["next_edge"]).alias("id"), "src", "dst", *props)
                    g.data["next_edge"] += n
                store(self.warehouse, g, kind, list(t.labels), df)
        self.warehouse.publish(g)

    def _find(self, name: str) -> bool:
        return name.lower() in self.mapped or self.stored(name) is not None

    def _changing(self, name: str | None, missing: str = "graph not exists") -> StoredGraph:
        """A copy of a stored graph for a change."""
        name = name if name is not None else self.current
        if name is None:
            raise CatalogError(missing)
        g = self.stored(name)
        if g is None:
            if name.lower() in self.mapped:
                raise BindError(f"graph {name} is mapped and can't be changed; import it")
            raise CatalogError(f"graph {name}: graph not exists")
        return g.copy()

    def _publish(self, g: StoredGraph) -> None:
        if self.staged is not None:
            self.staged[g.name.lower()] = g
            g.data["version"] += 1
        else:
            self.warehouse.publish(g)

    # statements
    def execute(self, text: str, params: list | tuple = ()) -> DataFrame:
        """The result of one statement; an empty DataFrame for those without one."""
        found = parse(text)
        if len(found) > 1:
            raise GraphError("multiple statements not supported")
        return self.run(found[0], list(params)) if found else self._nothing()

    def sql(self, text: str, params: list | tuple = ()) -> DataFrame:
        return self.execute(text, params)

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "result string")

    def _names(self, column: str, names: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(names)], f"{column} string")

    def run(self, n: A.Node, params: list) -> DataFrame:
        selector = Selector(self.graph, params, self.spark)
        match n:
            case A.Select():
                return selector.select(n)
            case A.Explain(q):
                plan = selector.select(q)._jdf.queryExecution().explainString(self.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
                return self.spark.createDataFrame([(line,) for line in plan.split("\n")], "plan string")
            case A.Use(name):
                if not self._find(name):
                    raise CatalogError(f"graph {name}: graph not exists")
                self.current = name
            case A.Show("graphs"):
                stored = {g.name for g in self.warehouse.graphs.values()} if self._has_store() else set()
                return self._names("graph", [*({g.name for g in (self.staged or {}).values()} | stored | {g.name for g in self.mapped.values()})])
            case A.Show(_, name):
                return self._names("label", self.graph(name).labels)
            case A.Create() | A.Drop():
                self._define(n)
            case A.Insert(_, into):
                g = self._changing(into)
                if n.matches and into is not None and self.current is None:
                    selector.graph_of = lambda name: self.graph(name or into)
                Modifier(selector, self.warehouse).insert(n, g)
                self._check_indexes(g)
                self._publish(g)
            case A.Update() | A.Delete():
                g = self._changing(next((m.graph for m in n.matches if m.graph), None), "no graph selected")
                modifier = Modifier(selector, self.warehouse)
                (modifier.update if isinstance(n, A.Update) else modifier.delete)(n, g)
                self._check_indexes(g)
                self._publish(g)
            case A.Transaction(action):
                self._transaction(action)
        return self._nothing()

    def _transaction(self, action: str) -> None:
        if action == "BEGIN":
            if self.staged is not None:
                raise GraphError("a transaction is open")
            self.staged = {}
        elif action == "COMMIT":
            staged, self.staged = self.staged or {}, None
            for g in staged.values():
                self.warehouse.publish(g)
        else:
            self.staged = None
            self._cached = (None,)

    def _define(self, n: A.Create | A.Drop) -> None:
        create = isinstance(n, A.Create)
        if not n.name or n.name.endswith(" "):
            raise CatalogError(f"incorrect {n.what} name")
        if n.what == "graph":
            if self._find(n.name) == create:
                if not n.lenient:
                    raise CatalogError(f"graph {n.name}: graph {'exists' if create else 'not exists'}")
                return
            if create:
                if self._warehouse is None:
                    self.warehouse  # noqa: B018 - made on first use
                self._publish(StoredGraph(n.name))
            elif n.name.lower() in self.mapped:
                del self.mapped[n.name.lower()]
            else:
                if self.staged is not None:
                    raise GraphError("DROP GRAPH can't be part of a transaction")
                self.warehouse.drop(n.name)
            if not create and self.current and self.current.lower() == n.name.lower():
                self.current = None
            return
        if self.current is None:
            if not create and n.lenient:
                return
            raise CatalogError("please choose graph first")
        g = self._changing(None)
        there = g.data["labels" if n.what == "label" else "indexes"]
        if (n.name.lower() in there) == create and n.lenient and n.what == "label":
            return
        if create and n.what == "index":
            for p in n.props:
                if p.lower() not in g.data["properties"]:
                    raise CatalogError(f"property {p}: property not exists")
        if (n.name.lower() in there) == create:
            if n.lenient:
                return
            raise CatalogError(f"{n.what} {n.name}: {n.what} {'exists' if create else 'not exists'}")
        if not create:
            del there[n.name.lower()]
        elif n.what == "label":
            there[n.name.lower()] = n.name
        else:
            if n.unique:
                self._check_unique(g, n.name, n.props)
            there[n.name.lower()] = {"name": n.name, "properties": n.props, "unique": n.unique}
        self._publish(g)

    def _check_indexes(self, g: StoredGraph) -> None:
        """Refuses a change after which a unique index has a value twice."""
        for index in g.data["indexes"].values():
            if index["unique"]:
                self._check_unique(g, index["name"], index["properties"])

    def _check_unique(self, g: StoredGraph, name: str, props: list[str]) -> None:
        from pathloom.operators.frame import Bound, common_props, scan

        graph = g.graph(self.spark)
        for kind, tables in (("vertex", graph.vertices), ("edge", graph.edges)):
            tables = [t for t in tables if all(p.lower() in t.props for p in props)]
            if tables:
                b = Bound("", kind, "u", graph, tables, common_props(tables, {p.lower() for p in props}))
                keys = [f"u_p_{p.lower()}" for p in props]
                if scan(b).dropna(subset=keys).groupBy(*keys).count().where("count > 1").limit(1).count():
                    raise CatalogError(f"index {name}: values are not unique")


