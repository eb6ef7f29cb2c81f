"""SELECT: conditions, subqueries, grouping, projection, ordering."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.expressions import NUMBERS, Value, bind, text_value, truth
from pathloom.lang import ast as A
from pathloom.lang.errors import BindError
from pathloom.operators.frame import Frame, Needs, is_horizontal, slot
from pathloom.operators.match import Matcher, conjuncts, names_of


class Selector:
    """Compiles SELECT and the parts that other statements share with it."""

    def __init__(self, graph_of, params: list, spark):
        self.graph_of, self.params, self.spark = graph_of, params, spark

    # matches and conditions
    def source(self, n: A.Node, needs: Needs, outer: Frame | None = None) -> Frame:
        """The frame of a statement's FROM and WHERE."""
        if not n.matches:
            return Frame(self.spark.range(1).select(F.lit(1).alias("one")), {}, {}, self.params)
        where = conjuncts(n.tail.where)
        matcher = Matcher(self.graph_of, needs, n.macros, self.params, self.spark)
        frame = matcher.compile(n.matches, where, outer)
        # one number for each match, whatever asks for it
        numbers = {A.text(x): x for x in n.walk(into_selects=False) if isinstance(x, A.Call) and x.name == "MATCH_NUMBER"}
        if numbers:
            name = slot("m")
            frame.df = frame.df.withColumn(name, F.monotonically_increasing_id() + 1)
            for key, x in numbers.items():
                frame.single(x.args[0].name)
                frame.attached[key] = Value(F.col(name), "int")
        for w in where:
            if isinstance(w, A.Exists):
                self.exists(frame, w, needs, n.macros)
            else:
                self.attach(frame, [w], needs, n.macros)
                frame.df = frame.df.where(truth(bind(w, frame), "WHERE"))
        return frame

    def attach(self, frame: Frame, exprs: list[A.Node], needs: Needs, macros: list) -> None:
        """Adds columns for the subqueries and degrees in expressions."""
        for e in exprs:
            for x in e.walk(into_selects=False):
                key = A.text(x)
                if key in frame.attached:
                    continue
                if isinstance(x, A.Exists):
                    name = slot("s")
                    self.exists(frame, replace(x, negated=False), needs, macros, name)
                    found = F.coalesce(F.col(name), F.lit(False))
                    frame.attached[key] = Value(~found if x.negated else found, "bool")
                elif isinstance(x, A.Subquery):
                    frame.attached[key] = self.scalar(frame, x.query, needs, macros)
                elif isinstance(x, A.Call) and x.name in ("IN_DEGREE", "OUT_DEGREE"):
                    frame.attached[key] = self.degree(frame, x)

    def degree(self, frame: Frame, n: A.Call) -> Value:
        if not isinstance(n.args[0], A.Var):
            raise BindError(f"{n.name} takes a vertex")
        b = frame.single(n.args[0].name)
        if b.kind != "vertex":
            raise BindError(f"{n.name} takes a vertex")
        end, name = "dst" if n.name == "IN_DEGREE" else "src", slot("d")
        ends = None
        for t in b.graph.edges:
            label = t.target if n.name == "IN_DEGREE" else t.source
            if label is None or any(v.has([label]) for v in b.tables):
                part = t.df.select(F.col(end).alias(f"{name}_id"))
                ends = part if ends is None else ends.unionAll(part)
        if ends is None:
            return Value(F.lit(0).cast("long"), "int")
        counts = ends.groupBy(f"{name}_id").agg(F.count(F.lit(1)).alias(name))
        frame.df = frame.df.join(counts, F.col(f"{b.slot}_id") == F.col(f"{name}_id"), "left").drop(f"{name}_id")
        return Value(F.coalesce(F.col(name), F.lit(0).cast("long")), "int")

    # subqueries: decorrelated by the outer columns that they use
    def correlate(self, frame: Frame, q: A.Select, needs: Needs) -> tuple[list[str], Frame]:
        """The outer columns that a subquery uses, and its matches for each different combination of them."""
        declared = {x.name.lower() for m in q.matches for x in m.walk() if isinstance(x, (A.Vertex, A.Edge)) and x.name}
        columns: list[str] = []
        inner_needs = Needs(q)
        for v in sorted({n.lower() for n in names_of(q)} | declared):
            if v not in frame.vars:
                continue
            b = frame.vars[v]
            if v in declared:
                own = [f"{b.slot}_id"]
            elif b.path is not None:
                own = [b.path]
            else:
                own = [c for c in b.columns() if c == f"{b.slot}_id" or v in inner_needs.star or c.endswith("_lab") and v in inner_needs.labels or any(c == f"{b.slot}_p_{p}" for p in inner_needs.props.get(v, ()))]
            columns += [c for c in own if c in frame.df.columns and c not in columns]
        if not columns:
            return [], self.source(q, inner_needs)
        base = Frame(frame.df.select(*columns).distinct(), dict(frame.vars), {}, self.params)
        return columns, self.source(q, inner_needs, base)

    def _grouped(self, q: A.Select) -> bool:
        exprs = [i.expr for i in q.items if i.expr is not None] + ([q.tail.having] if q.tail.having is not None else []) + [o.expr for o in q.tail.order]
        return bool(q.tail.group) or any(isinstance(x, A.Aggregate) for e in exprs for x in e.walk(into_selects=False))

    def exists(self, frame: Frame, n: A.Exists, needs: Needs, macros: list, mark: str | None = None) -> None:
        """Keeps the rows for which the subquery has a row (or none); with ``mark``, adds whether it has as a column."""
        q = replace(n.query, macros=[*macros, *n.query.macros])
        columns, inner = self.correlate(frame, q, needs)
        hits = inner.df
        if q.tail.group or q.tail.having is not None:
            inner = self.group(inner, q, [F.col(c) for c in columns], needs)
            hits = inner.df
        renamed = [f"{c}_x" for c in columns]
        if columns:
            hits = hits.select(*[F.col(c).alias(r) for c, r in zip(columns, renamed)]).distinct()
            on = None
            for c, r in zip(columns, renamed):
                eq = F.col(c).eqNullSafe(F.col(r))
                on = eq if on is None else on & eq
        else:
            hits, on = hits.select(F.lit(1).alias(slot("x"))).limit(1), F.lit(True)
        if mark is None:
            frame.df = frame.df.join(hits, on, "left_anti" if n.negated else "left_semi")
        else:
            frame.df = frame.df.join(hits.withColumn(mark, F.lit(True)), on, "left").drop(*renamed)

    def scalar(self, frame: Frame, q: A.Select, needs: Needs, macros: list) -> Value:
        """A subquery's one value for each row: null where it has no row; an error where it has several."""
        if len(q.items) != 1 or q.items[0].expr is None:
            raise BindError("a scalar subquery selects one value")
        if q.tail.group or q.tail.order or q.tail.limit is not None or q.tail.having is not None:
            raise BindError("a scalar subquery has no GROUP BY, HAVING, ORDER BY or LIMIT")
        q = replace(q, macros=[*macros, *q.macros])
        columns, inner = self.correlate(frame, q, needs)
        expr, name = q.items[0].expr, slot("q")
        self.attach(inner, [expr], Needs(q), q.macros)
        if self._grouped(q):
            if columns:  # so that no match counts as 0
                inner.hit = slot("h")
                matched = inner.df.withColumn(inner.hit, F.lit(1))
                keys = frame.df.select(*columns).distinct()
                key_names = [f"{c}_k" for c in columns]
                keys = keys.select(*[F.col(c).alias(k) for c, k in zip(columns, key_names)])
                on = None
                for c, k in zip(columns, key_names):
                    eq = F.col(c).eqNullSafe(F.col(k))
                    on = eq if on is None else on & eq
                inner.df = keys.join(matched, on, "left")
                group_by = [F.col(k).alias(c) for c, k in zip(columns, key_names)]
            else:
                group_by = []
            inner = self.group(inner, q, group_by, needs)
            v = bind(expr, inner)
            result = inner.df.select(*[F.col(c).alias(f"{c}_y") for c in columns], v.col.alias(name))
        else:
            v = bind(expr, inner)
            one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a scalar subquery returned more than one row"))).otherwise(F.first(v.col)).alias(name)
            rows = inner.df.groupBy(*[F.col(c).alias(f"{c}_y") for c in columns]) if columns else inner.df.groupBy()
            result = rows.agg(one)
        if columns:
            on = None
            for c in columns:
                eq = F.col(c).eqNullSafe(F.col(f"{c}_y"))
                on = eq if on is None else on & eq
            frame.df = frame.df.join(result, on, "left").drop(*[f"{c}_y" for c in columns])
        else:
            frame.df = frame.df.crossJoin(F.broadcast(result))  # one row
        return Value(F.col(name), v.type)

    # grouping
    def group(self, frame: Frame, q: A.Select, extra: list[Column], needs: Needs) -> Frame:
        """The frame after GROUP BY (or of one implicit group): grouped expressions and aggregates are its columns."""
        aliases = {i.alias.lower(): i.expr for i in q.items if i.alias is not None and i.expr is not None}
        out = Frame(None, {}, {}, self.params)
        keys: list[Column] = list(extra)
        firsts: list[Column] = []
        for item in q.tail.group:
            e = item.expr
            if isinstance(e, A.Var) and e.name.lower() not in frame.vars:
                if e.name.lower() not in aliases:
                    raise BindError(f"unresolved variable {e.name}")
                texts, e = [A.text(e)], aliases[e.name.lower()]
            else:
                texts = []
            if isinstance(e, A.Var):
                b = frame.single(e.name)
                keys.append(F.col(f"{b.slot}_id"))
                firsts += [F.first(c).alias(c) for c in b.columns() if c in frame.df.columns and c != f"{b.slot}_id"]
                out.vars[e.name.lower()] = b
                continue
            self.attach(frame, [e], needs, q.macros)
            v, name = bind(e, frame), slot("g")
            keys.append(v.col.alias(name))
            for t in [*texts, A.text(e), *([A.text(A.Var(item.alias))] if item.alias is not None else [])]:
                out.attached[t] = Value(F.col(name), v.type)
        exprs = [i.expr for i in q.items if i.expr is not None] + ([q.tail.having] if q.tail.having is not None else []) + [o.expr for o in q.tail.order]
        aggregates: list[Column] = []
        for e in exprs:
            self._aggregates(e, frame, out, aggregates, needs, q.macros)
        aggregates = aggregates or [F.count(F.lit(1)).alias(slot("a"))]
        out.df = frame.df.groupBy(*keys).agg(*aggregates, *firsts)
        return out

    def _aggregates(self, n: A.Node, frame: Frame, out: Frame, columns: list[Column], needs: Needs, macros: list) -> None:
        key = A.text(n)
        if key in out.attached or isinstance(n, A.Select):
            return
        if isinstance(n, A.Aggregate) and not is_horizontal(n, frame.vars):
            if n.arg is not None:
                self.attach(frame, [n.arg], needs, macros)
            name = slot("a")
            column, kind = self.vertical(n, frame)
            columns.append(column.alias(name))
            out.attached[key] = Value(F.col(name), kind)
            return
        for c in n.children():
            self._aggregates(c, frame, out, columns, needs, macros)

    def vertical(self, n: A.Aggregate, frame: Frame) -> tuple[Column, str]:
        """An aggregate over the rows of a group."""
        if n.arg is None:
            return F.count(F.col(frame.hit) if frame.hit else F.lit(1)), "int"
        arg = n.arg
        if isinstance(arg, A.Var) and frame.is_element(arg.name) and n.name in ("COUNT",):
            v = Value(frame.identity(arg.name), "int")
        else:
            v = bind(arg, frame)
        if frame.hit:
            v = Value(F.when(F.col(frame.hit).isNotNull(), v.col), v.type)
        c = v.col
        match n.name:
            case "COUNT":
                return F.count_distinct(c) if n.distinct else F.count(c), "int"
            case "MIN":
                return F.min(c), v.type
            case "MAX":
                return F.max(c), v.type
            case "ARRAY_AGG":
                return F.sort_array(F.collect_set(c) if n.distinct else F.collect_list(c)), "array"
            case "LISTAGG":
                values = F.sort_array(F.collect_set(c) if n.distinct else F.collect_list(c))
                joined = F.array_join(F.transform(values, lambda x: text_value(Value(x, v.type))), n.separator if n.separator is not None else "")
                return F.when(F.size(values) > 0, joined), "string"
        if v.type not in NUMBERS:
            raise BindError(f"cannot evaluate {n.name} on {v.type}")
        if n.name == "SUM":
            return F.sum_distinct(c) if n.distinct else F.sum(c), v.type
        wide = c.cast("double") if v.type != "decimal" else c
        return F.avg(wide) if not n.distinct else self._avg_distinct(wide), "float" if v.type != "decimal" else "decimal"

    @staticmethod
    def _avg_distinct(c: Column) -> Column:
        return F.sum_distinct(c) / F.count_distinct(c)

    # the statement
    def select(self, q: A.Select) -> DataFrame:
        needs = Needs(q)
        frame = self.source(q, needs)
        items = self.items(q, frame)
        if self._grouped(q) and not self._only_horizontal(q, frame):
            frame = self.group(frame, q, [], needs)
        exprs = [e for _, e in items if isinstance(e, A.Node)]
        order = [o.expr for o in q.tail.order]
        self.attach(frame, [*exprs, *order, *([q.tail.having] if q.tail.having is not None else [])], needs, q.macros)
        if q.tail.having is not None:
            frame.df = frame.df.where(truth(bind(q.tail.having, self._with_aliases(frame, q)), "HAVING"))
        named = [(name, bind(e, frame) if isinstance(e, A.Node) else e) for name, e in items]
        aliases = {i.alias.lower(): i.expr for i in q.items if i.alias is not None and i.expr is not None}
        columns = [v.col.alias(f"c{i}") for i, (_, v) in enumerate(named)]
        sort_scope = self._with_aliases(frame, q)
        sort = []
        for o in q.tail.order:
            e = aliases.get(o.expr.name.lower(), o.expr) if isinstance(o.expr, A.Var) else o.expr
            i = next((i for i, (_, x) in enumerate(items) if isinstance(x, A.Node) and A.text(x) == A.text(e)), None)
            c = frame.single(e.name) if i is None and isinstance(e, A.Var) and frame.is_element(e.name) else None
            v = bind(e, sort_scope) if i is None and c is None else None
            if i is not None and isinstance(items[i][1], A.Var) and frame.is_element(items[i][1].name):
                c, i = frame.single(items[i][1].name), None
            sort.append((o, f"c{i}" if i is not None else None, F.col(f"{c.slot}_id") if c is not None else v.col if v is not None else None))
        hidden = [x.alias(f"s{k}") for k, (_, at, x) in enumerate(sort) if at is None]
        if q.distinct and hidden:
            raise BindError("with DISTINCT, ORDER BY takes what is selected")
        df = frame.df.select(*columns, *hidden)
        if q.distinct:
            df = df.distinct()
        if sort:
            by = [F.col(at or f"s{k}") for k, (_, at, _) in enumerate(sort)]
            df = df.orderBy(*[c.desc_nulls_first() if o.descending else c.asc_nulls_last() for c, (o, _, _) in zip(by, sort)])
        if q.tail.offset is not None:
            df = df.offset(self.number(q.tail.offset))
        if q.tail.limit is not None:
            df = df.limit(self.number(q.tail.limit))
        return df.select(*[F.col(f"c{i}").alias(name) for i, (name, _) in enumerate(named)])

    def number(self, n: A.Node) -> int:
        if isinstance(n, A.Param):
            if n.index >= len(self.params) or not isinstance(self.params[n.index], int) or self.params[n.index] < 0:
                raise BindError("LIMIT and OFFSET take integers that aren't negative")
            return self.params[n.index]
        return n.value

    def _only_horizontal(self, q: A.Select, frame: Frame) -> bool:
        """Whether all aggregates outside of aggregates are along paths, and nothing is grouped."""
        if q.tail.group:
            return False

        def vertical(n: A.Node) -> bool:
            if isinstance(n, A.Select):
                return False
            if isinstance(n, A.Aggregate):
                return not is_horizontal(n, frame.vars)
            return any(vertical(c) for c in n.children())

        exprs = [i.expr for i in q.items if i.expr is not None] + ([q.tail.having] if q.tail.having is not None else []) + [o.expr for o in q.tail.order]
        return not any(vertical(e) for e in exprs)

    def _with_aliases(self, frame: Frame, q: A.Select) -> Frame:
        """The frame in which a select item's alias means its value."""
        out = replace(frame, attached=dict(frame.attached))
        for i in q.items:
            if i.alias is not None and i.expr is not None and i.alias.lower() not in frame.vars:
                try:
                    out.attached.setdefault(A.text(A.Var(i.alias)), bind(i.expr, frame))
                except BindError:
                    continue
        return out

    def items(self, q: A.Select, frame: Frame) -> list[tuple[str, A.Node | Value]]:
        """Names and expressions of the columns."""
        if not q.items:
            out = []
            for v in frame.order:
                if v in frame.vars:
                    b = frame.vars[v]
                    out.append((b.name, A.Aggregate("ARRAY_AGG", A.Var(b.name)) if b.path else A.Var(b.name)))
            return out
        out = []
        for i in q.items:
            if i.star is None:
                out.append((i.alias if i.alias is not None else A.text(i.expr), i.expr))
                continue
            b = frame.single(i.star)
            out += [((i.prefix or "") + name, A.Prop(b.name, name)) for name, _ in b.props.values()]
        return out

