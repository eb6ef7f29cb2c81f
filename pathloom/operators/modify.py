"""INSERT, UPDATE and DELETE on stored graphs: the match is read from one snapshot, the result published as the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.expressions import bind
from pathloom.lang import ast as A
from pathloom.lang.errors import BindError
from pathloom.operators.frame import Frame, Needs
from pathloom.operators.select import Selector
from pathloom.plans.durable import durable
from pathloom.sources.catalog import StoredGraph, Warehouse, p_name, store
from pathloom.sources.graph import ElementTable


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` with _n, gapless from 0, and its number of rows: from per-partition counts, without one big sort."""
    kept = durable(df.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    counts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("c"), F.min("_row").alias("first")).orderBy("_part").collect()
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["_part"], before - r["first"]))
        before += r["c"]
    if not offsets:
        return kept.withColumn("_n", F.lit(0).cast("long")).drop("_part", "_row"), 0
    table = df.sparkSession.createDataFrame(offsets, "_part int, _shift long")  # one row a partition
    return kept.join(F.broadcast(table), "_part").withColumn("_n", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift"), before


class Modifier:
    def __init__(self, selector: Selector, warehouse: Warehouse):
        self.selector, self.warehouse = selector, warehouse

    def _values(self, n: A.Node, exprs: list[A.Node], needs: Needs, extra: dict[str, str]) -> tuple[DataFrame, list[str]]:
        """One row for each row of the statement's source: the expressions' values, and the ids of ``extra`` variables."""
        frame = self.selector.source(n, needs)
        if n.tail.group or any(isinstance(x, A.Aggregate) for e in exprs for x in e.walk(into_selects=False)):
            q = A.Select(n.macros, [A.Item(e) for e in exprs], False, n.matches, n.tail)
            frame = self.selector.group(frame, q, [], needs)
        self.selector.attach(frame, exprs, needs, n.macros)
        if n.tail.having is not None:
            self.selector.attach(frame, [n.tail.having], needs, n.macros)
            frame.df = frame.df.where(bind(n.tail.having, frame).col)
        columns = [bind(e, frame).col.alias(f"x{i}") for i, e in enumerate(exprs)]
        columns += [frame.identity(v).alias(c) for v, c in extra.items()]
        df = frame.df
        if n.tail.order:
            df = df.orderBy(*[bind(o.expr, frame).col.desc_nulls_first() if o.descending else bind(o.expr, frame).col.asc_nulls_last() for o in n.tail.order])
        if n.tail.offset is not None:
            df = df.offset(self.selector.number(n.tail.offset))
        if n.tail.limit is not None:
            df = df.limit(self.selector.number(n.tail.limit))
        return df.select(*columns, *([F.lit(1).alias("one")] if not columns else [])), [f"x{i}" for i in range(len(exprs))]

    def insert(self, n: A.Insert, g: StoredGraph) -> None:
        for e in n.elements:
            for x in e.labels:
                g.label(x)
            for p, _ in e.props:
                if e.name is None or p.var.lower() != e.name.lower():
                    raise BindError(f"{p}: reference not exists variable")
        vertices = [e for e in n.elements if isinstance(e, A.NewVertex)]
        edges = [e for e in n.elements if isinstance(e, A.NewEdge)]
        made = {e.name.lower(): i for i, e in enumerate(vertices) if e.name}
        ends = {v.lower() for e in edges for v in (e.source, e.target)} - set(made)
        exprs = [x for e in n.elements for _, x in e.props]
        extra = {v: f"v_{i}" for i, v in enumerate(sorted(ends))}
        df, names = self._values(n, exprs, Needs(n), extra)
        rows, count = numbered(df)
        if not count:
            return
        places, i = {}, 0
        for e in n.elements:
            places[id(e)] = names[i : i + len(e.props)]
            i += len(e.props)
        first_vertex, first_edge = g.data["next_vertex"], g.data["next_edge"]

        def vertex_id(k: int):
            return F.lit(first_vertex + k) + F.col("_n") * len(vertices)

        def props(e) -> list:
            seen = [p.name.lower() for p, _ in e.props]
            if len(set(seen)) < len(seen):
                raise BindError("a property is set twice")
            return [F.col(c).alias(g.data["properties"].get(p.name.lower(), p.name)) for c, (p, _) in zip(places[id(e)], e.props)]

        for k, e in enumerate(vertices):
            store(self.warehouse, g, "vertices", e.labels, rows.select(vertex_id(k).alias("id"), *props(e)))
        for k, e in enumerate(edges):
            src, dst = (vertex_id(made[v.lower()]) if v.lower() in made else F.col(extra[v.lower()]) for v in (e.source, e.target))
            store(self.warehouse, g, "edges", e.labels, rows.select((F.lit(first_edge + k) + F.col("_n") * len(edges)).alias("id"), src.alias("src"), dst.alias("dst"), *props(e)))
        g.data["next_vertex"] += count * len(vertices)
        g.data["next_edge"] += count * len(edges)

    def _element(self, frame: Frame, name: str, g: StoredGraph):
        b = frame.single(name)
        if b.graph.name.lower() != g.name.lower():
            raise BindError(f"{name} is not of graph {g.name}")
        return b

    def update(self, n: A.Update, g: StoredGraph) -> None:
        needs = Needs(n)
        frame = self.selector.source(n, needs)
        exprs = [x for c in n.changes for _, x in c.props]
        self.selector.attach(frame, exprs, needs, n.macros)
        columns, i = [], 0
        plan: dict[str, tuple] = {}
        for c in n.changes:
            b = self._element(frame, c.name, g)
            key = c.name.lower()
            if key not in plan:
                plan[key] = (b, {})
                columns.append(frame.identity(c.name).alias(f"id_{key}"))
            for p, x in c.props:
                if p.var.lower() != key:
                    raise BindError(f"{p}: reference not exists variable")
                if p.name.lower() in plan[key][1]:
                    raise BindError(f"property {p.name} is set twice")
                plan[key][1][p.name.lower()] = (p.name, f"x{i}")
                columns.append(bind(x, frame).col.alias(f"x{i}"))
                i += 1
        rows = durable(frame.df.select(*columns))
        changes: dict[tuple[str, str], list] = {}
        for key, (b, props) in plan.items():
            kind = "vertices" if b.kind == "vertex" else "edges"
            each = rows.select(F.col(f"id_{key}").alias("_id"), *[F.col(c).alias(f"_{p}") for p, (_, c) in props.items()]).distinct()
            changes.setdefault(kind, []).append((b, props, each))
        for kind, parts in changes.items():
            for b, props, each in parts:
                if each.groupBy("_id").count().where("count > 1").limit(1).count():
                    raise BindError(f"different values for one property of {b.name}")
                self._rewrite(g, kind, b.tables, each, props)

    def _rewrite(self, g: StoredGraph, kind: str, tables: list[ElementTable], each: DataFrame, props: dict[str, tuple[str, str]]) -> None:
        """Copies of the tables that hold changed rows, with the new values."""
        for t in list(g.data[kind]):
            if not t["parts"] or not any(sorted(x.lower() for x in t["labels"] if x.lower() in g.data["labels"]) == sorted(x.lower() for x in e.labels) for e in tables):
                continue
            old = self.selector_read(g, t, kind)
            if not old.join(each, old["id"] == each["_id"], "left_semi").limit(1).count():
                continue
            joined = old.join(each, old["id"] == each["_id"], "left")
            own = ["id"] if kind == "vertices" else ["id", "src", "dst"]
            columns = [F.col(c) for c in own]
            for p in t["props"]:
                name = p_name(t, p)
                columns.append((F.when(F.col("_id").isNotNull(), F.col(f"_{p}")).otherwise(F.col(f"`{name}`")) if p in props else F.col(f"`{name}`")).alias(name))
            columns += [F.col(f"_{p}").alias(g.data["properties"].get(p, name)) for p, (name, _) in props.items() if p not in t["props"]]
            store(self.warehouse, g, kind, t["labels"], joined.select(*columns), replace=True)

    def selector_read(self, g: StoredGraph, t: dict, kind: str) -> DataFrame:
        return g.read(self.warehouse.spark, t, kind)

    def delete(self, n: A.Delete, g: StoredGraph) -> None:
        needs = Needs(n)
        frame = self.selector.source(n, needs)
        doomed: dict[str, DataFrame] = {}
        columns = []
        for v in n.names:
            b = self._element(frame, v, g)
            columns.append((("vertices" if b.kind == "vertex" else "edges"), frame.identity(v)))
        rows = durable(frame.df.select(*[c.alias(f"d{i}") for i, (_, c) in enumerate(columns)]))
        for i, (kind, _) in enumerate(columns):
            ids = rows.select(F.col(f"d{i}").alias("_id")).distinct()
            doomed[kind] = ids if kind not in doomed else doomed[kind].unionAll(ids).distinct()
        for kind in ("edges", "vertices"):
            for t in g.data[kind]:
                if not t["parts"]:
                    continue
                old = rest = self.selector_read(g, t, kind)
                if kind in doomed:
                    rest = rest.join(doomed[kind], rest["id"] == doomed[kind]["_id"], "left_anti")
                if kind == "edges" and "vertices" in doomed:  # a vertex takes its edges with it
                    gone = doomed["vertices"]
                    rest = rest.join(gone, F.col("src") == gone["_id"], "left_anti").join(gone, F.col("dst") == gone["_id"], "left_anti")
                if rest is not old:
                    t["parts"] = [self.warehouse.write(g, rest)]


