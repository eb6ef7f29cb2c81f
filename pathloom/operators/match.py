"""Patterns to DataFrames: a join for each edge and vertex, loops for paths; Catalyst picks the joins and pushes filters.

Tables are chosen by labels, and by which tables an edge's end points can lie in. Vertices of which nothing is asked
are not scanned where the graph's edges are known to be sound.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.expressions import NUMBERS, bind, number_as, truth
from pathloom.lang import ast as A
from pathloom.lang.errors import BindError, CatalogError
from pathloom.operators.frame import Bound, Frame, Needs, common_props, scan, slot
from pathloom.operators.paths import all_walks, best_walks, reachable
from pathloom.plans.durable import durable
from pathloom.sources.graph import ElementTable, PropertyGraph


@dataclass
class VertexVar:
    key: str
    name: str | None
    graph: PropertyGraph
    tables: list[ElementTable]
    labelled: bool = False
    number: int = 1
    outer: Bound | None = None
    bound: Bound | None = None


@dataclass
class EdgeVar:
    key: str
    name: str | None
    graph: PropertyGraph
    tables: list[ElementTable]
    a: str
    b: str
    any: bool
    number: int = 2


@dataclass
class PathVar:
    link: A.Node
    a: str
    b: str
    goal: str
    k: int
    graph: PropertyGraph


@dataclass
class Pattern:
    vertices: dict[str, VertexVar] = field(default_factory=dict)
    edges: list[EdgeVar] = field(default_factory=list)
    paths: list[PathVar] = field(default_factory=list)
    order: list[str] = field(default_factory=list)


class Matcher:
    """Compiles the MATCH clauses of a statement."""

    def __init__(self, graph_of: Callable[[str | None], PropertyGraph], needs: Needs, macros: list[A.Macro], params: list, spark):
        self.graph_of, self.needs, self.params, self.spark = graph_of, needs, params, spark
        self.macros = {m.name.lower(): m for m in macros}
        self.count = 0

    # the pattern
    def pattern(self, matches: list[A.Match], outer: Frame | None) -> Pattern:
        p = Pattern()
        for m in matches:
            graph = self.graph_of(m.graph)
            for path in m.paths:
                keys = [self._vertex(p, v, graph, outer, 2 * i + 1) for i, v in enumerate(path.vertices)]
                for i, link in enumerate(path.links):
                    a, b = keys[i], keys[i + 1]
                    if isinstance(link, A.Edge):
                        if link.direction == "in":
                            a, b = b, a
                        p.edges.append(EdgeVar(self._name(p, link.name), link.name, graph, self._tables(graph, link.labels, "edges"), a, b, link.direction == "any", 2 * i + 2))
                    else:
                        p.paths.append(PathVar(link, a, b, path.goal, path.k, graph))
                        if isinstance(link, A.Quantified):
                            for x in (link.left, link.edge, link.right):
                                if x is not None and x.name:
                                    self._name(p, x.name)
        # as written: a path's vertices and links in turn
        written = [x.name.lower() for m in matches for path in m.paths for pair in zip(path.vertices, [*path.links, None]) for y in pair if y is not None for x in y.walk() if isinstance(x, (A.Vertex, A.Edge)) and x.name]
        p.order.sort(key=lambda v: written.index(v) if v in written else -1)
        return p

    def _name(self, p: Pattern, name: str | None) -> str:
        self.count += 1
        if name is None:
            return f"#{self.count}"
        if name.lower() in p.order:
            raise BindError(f"variable {name} is bound twice")
        p.order.append(name.lower())
        return name.lower()

    def _vertex(self, p: Pattern, v: A.Vertex, graph: PropertyGraph, outer: Frame | None, number: int) -> str:
        tables = self._tables(graph, v.labels, "vertices")
        key = v.name.lower() if v.name else self._name(p, None)
        if key in p.vertices:
            known = p.vertices[key]
            if known.graph is not graph:
                raise BindError(f"variable {v.name} belongs to two graphs")
            known.tables = [t for t in known.tables if any(t is x for x in tables)]
            known.labelled |= bool(v.labels)
            return key
        if v.name and key in p.order:
            raise BindError(f"variable {v.name} is bound twice")
        found = VertexVar(key, v.name, graph, tables, bool(v.labels), number)
        if outer is not None and v.name and key in outer.vars:
            found.outer = outer.vars[key]
            if found.outer.kind != "vertex" or found.outer.path:
                raise BindError(f"variable {v.name} is bound twice")
            found.tables = [t for t in tables if any(t is x for x in found.outer.tables)]
        if v.name:
            p.order.append(key)
        p.vertices[key] = found
        return key

    @staticmethod
    def _tables(graph: PropertyGraph, labels: list[str], kind: str) -> list[ElementTable]:
        for x in labels:
            if not graph.knows(x):
                raise CatalogError(f"label {x}: label not exists")
        return [t for t in getattr(graph, kind) if not labels or t.has(labels)]

    @staticmethod
    def infer(p: Pattern) -> None:
        """Drops edge tables whose end points can't match, and vertex tables that no edge leads to; until nothing drops."""
        def end(t: ElementTable, label: str | None, v: VertexVar) -> bool:
            return label is None or any(x.has([label]) for x in v.tables)

        changed = True
        while changed:
            changed = False
            for e in p.edges:
                a, b = p.vertices[e.a], p.vertices[e.b]

                def fits(t: ElementTable, a=a, b=b, both=e.any) -> bool:
                    return end(t, t.source, a) and end(t, t.target, b) or both and end(t, t.source, b) and end(t, t.target, a)

                left = [t for t in e.tables if fits(t)]
                changed |= len(left) < len(e.tables)
                e.tables = left
                for v, own, other in ((a, "source", "target"), (b, "target", "source")):
                    if any(getattr(t, x) is None for t in left for x in (own, *([other] if e.any else []))):
                        continue
                    labels = [getattr(t, x) for t in left for x in (own, *([other] if e.any else []))]
                    kept = [t for t in v.tables if t.has(labels)] if labels else []
                    changed |= len(kept) < len(v.tables)
                    v.tables = kept

    # compiling
    def compile(self, matches: list[A.Match], where: list[A.Node], outer: Frame | None = None) -> Frame:
        """The frame of all matches; ``where``: conjuncts that may be used early (they are applied by the caller)."""
        p = self.pattern(matches, outer)
        self.infer(p)
        frame = Frame(outer.df if outer is not None else None, dict(outer.vars) if outer is not None else {}, {}, self.params, list(p.order))
        for v in p.vertices.values():
            frame.vars.pop(v.key, None)
        if outer is not None:
            frame.attached = dict(outer.attached)
            for v in p.vertices.values():
                if v.outer is not None:
                    self._bind_vertex(frame, v, F.col(f"{v.outer.slot}_id"))
        edges, paths = list(p.edges), list(p.paths)
        while edges or paths or any(v.bound is None for v in p.vertices.values()):
            known = lambda k: p.vertices[k].bound is not None
            nxt = next((e for e in edges if known(e.a) and known(e.b)), None) or next((e for e in edges if known(e.a) or known(e.b)), None)
            if nxt is not None:
                edges.remove(nxt)
                self._edge(frame, p, nxt)
                continue
            way = next((x for x in paths if known(x.a) or known(x.b)), None)
            if way is not None and not (edges and frame.df is None):
                paths.remove(way)
                self._path(frame, p, way, where)
                continue
            # a new component: from an edge, a filtered vertex, or any vertex
            if edges:
                self._edge(frame, p, edges.pop(0))
            elif paths:
                x = paths[0]
                names = {n.lower() for w in where for n in names_of(w)}
                start = x.b if x.b in names and x.a not in names else x.a
                self._scan_vertex(frame, p.vertices[start])
            else:
                self._scan_vertex(frame, next(v for v in p.vertices.values() if v.bound is None))
        return frame

    def _join(self, frame: Frame, right: DataFrame, on: Column | None) -> None:
        if frame.df is None:
            frame.df = right if on is None else right.where(on)
        else:
            frame.df = frame.df.crossJoin(right) if on is None else frame.df.join(right, on)

    def _new(self, name: str | None, kind: str, graph: PropertyGraph, tables: list[ElementTable], number: int) -> Bound:
        key = name.lower() if name else ""
        wanted = None if key in self.needs.star else self.needs.props.get(key, set())
        return Bound(name or "", kind, slot("v" if kind == "vertex" else "e"), graph, tables, common_props(tables, wanted), number=number)

    def _asked(self, v: VertexVar) -> bool:
        """Whether a vertex must be scanned: for what is asked of it, its labels, or its being there."""
        k = v.key
        if not v.graph.sound or k in self.needs.star or k in self.needs.labels or self.needs.props.get(k):
            return True
        return v.labelled and any(t.source is None for t in v.graph.edges)

    def _scan_vertex(self, frame: Frame, v: VertexVar) -> None:
        v.bound = self._new(v.name, "vertex", v.graph, v.tables, v.number)
        self._join(frame, self._scan(v.bound), None)
        self._name_it(frame, v)

    def _name_it(self, frame: Frame, v: VertexVar) -> None:
        if v.name:
            frame.vars[v.key] = v.bound

    def _scan(self, b: Bound, identity: bool = True) -> DataFrame:
        if b.tables:
            return scan(b, identity)
        fields = [f"{b.slot}_id long", f"{b.slot}_lab array<string>"] + ([f"{b.slot}_src long", f"{b.slot}_dst long"] if b.kind == "edge" else [])
        return self.spark.createDataFrame([], ", ".join(fields))

    def _bind_vertex(self, frame: Frame, v: VertexVar, at: Column) -> None:
        """Makes the vertex with this id known, by a join if it must be scanned."""
        v.bound = self._new(v.name, "vertex", v.graph, v.tables, v.number)
        if v.outer is not None or self._asked(v) or not v.tables:
            self._join(frame, self._scan(v.bound), at == F.col(f"{v.bound.slot}_id"))
        else:
            v.bound.scanned = False
            frame.df = frame.df.withColumn(f"{v.bound.slot}_id", at)
        self._name_it(frame, v)

    def _edge(self, frame: Frame, p: Pattern, e: EdgeVar) -> None:
        b = self._new(e.name, "edge", e.graph, e.tables, e.number)
        right = self._ends(b, e)
        s = b.slot
        va, vb = p.vertices[e.a], p.vertices[e.b]
        on = None
        for v, c in ((va, f"{s}_from"), (vb, f"{s}_to")):
            if v.bound is not None:
                eq = F.col(f"{v.bound.slot}_id") == F.col(c)
                on = eq if on is None else on & eq
        self._join(frame, right, on)
        if va.bound is None:
            self._bind_vertex(frame, va, F.col(f"{s}_from"))
            if va is vb:
                frame.df = frame.df.where(F.col(f"{s}_from") == F.col(f"{s}_to"))
        if vb.bound is None:
            self._bind_vertex(frame, vb, F.col(f"{s}_to"))
        if e.name:
            frame.vars[e.key] = b

    def _ends(self, b: Bound, e: EdgeVar, identity: bool | None = None) -> DataFrame:
        """The edge's scan with from and to: its ends in the direction of the pattern; for any direction both ways round
        (a loop once)."""
        s = b.slot
        if identity is None:
            identity = e.name is not None and e.name.lower() in self.needs.whole
        rows = self._scan(b, identity)
        forth = rows.withColumns({f"{s}_from": F.col(f"{s}_src"), f"{s}_to": F.col(f"{s}_dst")})
        if not e.any:
            return forth
        back = rows.withColumns({f"{s}_from": F.col(f"{s}_dst"), f"{s}_to": F.col(f"{s}_src")}).where(F.col(f"{s}_src") != F.col(f"{s}_dst"))
        return forth.unionByName(back)

    # paths
    def _path(self, frame: Frame, p: Pattern, x: PathVar, where: list[A.Node]) -> None:
        va, vb = p.vertices[x.a], p.vertices[x.b]
        # conditions on what is bound already cut the seeds
        for w in where:
            names = {n.lower() for n in names_of(w)}
            if names and names <= set(frame.vars) and not any(isinstance(n, (A.Select, A.Aggregate, A.Call)) for n in w.walk()) and not any(frame.vars[n].path for n in names):
                frame.df = frame.df.where(truth(bind(w, frame), "WHERE"))
        # where only the target is known the search goes backwards (reachability), or from all sources (others)
        backwards = va.bound is None and isinstance(x.link, A.Reach)
        if va.bound is None and not backwards:
            self._scan_vertex(frame, va)
        start, other = (vb, va) if backwards else (va, vb)
        at = f"{start.bound.slot}_id"
        seeds = durable(frame.df.select(F.col(at).alias("root")).where("root is not null").distinct())
        if isinstance(x.link, A.Reach):
            found = self._reach(x, seeds, backwards)
        else:
            found = self._quantified(frame, p, x, seeds)
        s = slot("r")
        found = found.withColumnsRenamed({"root": f"{s}_root", "node": f"{s}_node"})
        on = F.col(at) == F.col(f"{s}_root")
        if other.bound is not None:
            on = on & (F.col(f"{other.bound.slot}_id") == F.col(f"{s}_node"))
        frame.df = frame.df.join(found, on)
        if other.bound is None:
            other.bound = self._new(other.name, "vertex", other.graph, other.tables, other.number)
            # a zero-hop path ends where it begins, whatever the target's label: it must be looked up
            self._join(frame, self._scan(other.bound), F.col(f"{s}_node") == F.col(f"{other.bound.slot}_id"))
            self._name_it(frame, other)

    def _reach(self, x: PathVar, seeds: DataFrame, backwards: bool) -> DataFrame:
        link = x.link
        parts = []
        labels = [n for n in link.labels if n.lower() not in self.macros]
        for n in link.labels:
            if n.lower() in self.macros:
                parts.append(self._macro(self.macros[n.lower()], x.graph))
        if labels:
            b = Bound("", "edge", slot("e"), x.graph, self._tables(x.graph, labels, "edges"), {})
            parts.append(self._scan(b, False).select(F.col(f"{b.slot}_src").alias("from"), F.col(f"{b.slot}_dst").alias("to")))
        hops = parts[0]
        for q in parts[1:]:
            hops = hops.unionByName(q)
        swapped = hops.select(F.col("to").alias("from"), F.col("from").alias("to"))
        if link.direction == "any":
            hops = hops.unionByName(swapped)
        elif (link.direction == "in") != backwards:
            hops = swapped
        return reachable(hops, seeds, link.low, link.high)

    def _macro(self, m: A.Macro, graph: PropertyGraph) -> DataFrame:
        """The macro's pattern as hops from its first vertex to its last, its condition applied inside."""
        if any(isinstance(e, A.Quantified) for e in m.path.links) or m.path.goal != "match":
            raise BindError(f"path macro {m.name} must be a simple path")
        ends = [m.path.vertices[0], m.path.vertices[-1]]
        first, last = (replace(v, name=v.name or f"#end{i}") for i, v in enumerate(ends))
        vertices = [first, *m.path.vertices[1:-1], last] if len(m.path.vertices) > 1 else [first]
        others = [q for q in self.macros.values() if q is not m]
        inner = Matcher(lambda name: graph if name is None else self.graph_of(name), Needs(m), others, self.params, self.spark)
        inner.needs.whole |= {first.name.lower(), last.name.lower()}
        where = conjuncts(m.where)
        f = inner.compile([A.Match([replace(m.path, vertices=vertices)], None)], where)
        for w in where:
            f.df = f.df.where(truth(bind(w, f), "WHERE"))
        return f.df.select(f.identity(vertices[0].name).alias("from"), f.identity(vertices[-1].name).alias("to")).distinct()

    def _quantified(self, frame: Frame, p: Pattern, x: PathVar, seeds: DataFrame) -> DataFrame:
        q = x.link
        e = q.edge
        path = slot("p")
        inner = Pattern()
        tables = self._tables(x.graph, e.labels, "edges")
        left = VertexVar("#l", q.left.name if q.left else None, x.graph, self._tables(x.graph, q.left.labels if q.left else [], "vertices"), bool(q.left and q.left.labels))
        right = VertexVar("#r", q.right.name if q.right else None, x.graph, self._tables(x.graph, q.right.labels if q.right else [], "vertices"), bool(q.right and q.right.labels))
        ev = EdgeVar("#e", e.name, x.graph, tables, "#l", "#r", e.direction == "any")
        inner.vertices, inner.edges = {"#l": left, "#r": right}, [ev]
        if e.direction == "in":
            # as written, the hop goes from left to right against the edge
            ev.a, ev.b = "#r", "#l"
        self.infer(inner)
        b = self._new(e.name, "edge", x.graph, ev.tables, 2)
        rows = self._ends(b, ev, True)
        hop_frame = Frame(rows, dict(frame.vars), {}, self.params)
        if e.name:
            hop_frame.vars[e.name.lower()] = b
        group: list[Bound] = [b] if e.name else []
        here, there = (f"{b.slot}_to", f"{b.slot}_from") if e.direction == "in" else (f"{b.slot}_from", f"{b.slot}_to")
        for v, at, number in ((left, here, 1), (right, there, 3)):
            if v.name or v.labelled:
                v.bound = self._new(v.name, "vertex", x.graph, v.tables, number)
                hop_frame.df = hop_frame.df.join(self._scan(v.bound), F.col(at) == F.col(f"{v.bound.slot}_id"))
                if v.name:
                    hop_frame.vars[v.name.lower()] = v.bound
                    group.append(v.bound)
        if q.where is not None:
            hop_frame.df = hop_frame.df.where(truth(bind(q.where, hop_frame), "WHERE"))
        by_cost = x.goal == "cheapest"
        if q.cost is not None and not by_cost:
            raise BindError("COST needs CHEAPEST")
        cost = F.lit(1).cast("long")
        if by_cost and q.cost is not None:
            v = bind(q.cost, hop_frame)
            if v.type not in NUMBERS:
                raise BindError(f"a cost of type {v.type}")
            cost = number_as(v, v.type).cast({"int": "bigint", "float": "double", "decimal": "decimal(38,12)"}[v.type])
        columns = []
        for g in group:
            key = g.name.lower()
            whole = key in self.needs.star
            own = ["id"] + ["lab"] * (whole or key in self.needs.labels) + ["src", "dst"] * (whole and g.kind == "edge") + [f"p_{p}" for p in g.props]
            columns += [f"{g.slot}_{c}" for c in own]
        hop = F.struct(*(columns or [f"{b.slot}_id"]))
        # ids made on the fly become data here, so that all steps see the same ones
        hops = durable(hop_frame.df.select(F.col(here).alias("from"), F.col(there).alias("to"), F.col(f"{b.slot}_id").alias("hop_id"), cost.alias("hop_cost"), hop.alias("hop")))
        for g in group:
            g.path = path
            frame.vars[g.name.lower()] = g
        if x.goal == "all":
            found = all_walks(hops, seeds, q.low, q.high)
        else:
            found = best_walks(hops, seeds, q.low, q.high, x.k, by_cost)
        return found.select("root", "node", F.col("path").alias(path))


def conjuncts(n: A.Node | None) -> list[A.Node]:
    if n is None:
        return []
    if isinstance(n, A.Paren):
        return conjuncts(n.arg)
    if isinstance(n, A.Binary) and n.op == "AND":
        return conjuncts(n.left) + conjuncts(n.right)
    return [n]


def names_of(n: A.Node) -> set[str]:
    return {x.name if isinstance(x, A.Var) else x.var for x in n.walk() if isinstance(x, (A.Var, A.Prop))}

