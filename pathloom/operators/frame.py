"""A frame: a DataFrame of matches with what the statement's names mean in it."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.expressions import NUMBERS, Scope, Value, bind, kind_of, literal, text_value
from pathloom.lang import ast as A
from pathloom.lang.errors import BindError
from pathloom.sources.graph import ElementTable, PropertyGraph, edge_id

_slots = itertools.count()


def slot(prefix: str) -> str:
    return f"{prefix}{next(_slots)}"


class Needs:
    """What a statement asks of each variable; by name, over the statement and all its subqueries."""

    def __init__(self, n: A.Node):
        self.props: dict[str, set[str]] = {}
        self.whole: set[str] = set()  # identity
        self.star: set[str] = set()  # all properties
        self.labels: set[str] = set()
        self._visit(n, value=False)

    def _visit(self, n: A.Node, value: bool) -> None:
        match n:
            case A.Prop(v, p):
                self.props.setdefault(v.lower(), set()).add(p.lower())
            case A.Var(v):
                self.whole.add(v.lower())
                if value:
                    self.star.add(v.lower())
                    self.labels.add(v.lower())
            case A.Call("LABEL" | "LABELS" | "HAS_LABEL", args) if isinstance(args[0], A.Var):
                self.labels.add(args[0].name.lower())
                for a in args[1:]:
                    self._visit(a, False)
                return
            case A.Item(e, _, star, _):
                if star:
                    self.star.add(star.lower())
                elif isinstance(e, A.Var):
                    self._visit(e, True)
                    return
            case A.Aggregate("ARRAY_AGG" | "MIN" | "MAX", A.Var(_) as e):
                self._visit(e, True)
                return
            case A.Select(_, items, _, matches, _) if not items:
                for m in matches:
                    for x in m.walk():
                        if isinstance(x, (A.Vertex, A.Edge)) and x.name:
                            self.whole.add(x.name.lower())
                            self.star.add(x.name.lower())
                            self.labels.add(x.name.lower())
            case A.Exists(q, _) if not q.items:  # EXISTS (SELECT * ...) asks for no columns
                for c in q.children():
                    self._visit(c, False)
                return
            case A.NewEdge(_, a, b, _, _):
                self.whole |= {a.lower(), b.lower()}
            case A.Change(v, _):
                self.whole.add(v.lower())
            case A.Delete(_, names, _, _):
                self.whole |= {v.lower() for v in names}
        for c in n.children():
            self._visit(c, False)


@dataclass
class Bound:
    """A variable: its columns begin with ``slot``. ``path``: the array of hops that a group variable lives in."""

    name: str
    kind: str  # vertex or edge
    slot: str
    graph: PropertyGraph
    tables: list[ElementTable]
    props: dict[str, tuple[str, T.DataType]]
    path: str | None = None
    number: int = 0  # place in its path
    scanned: bool = True

    def columns(self) -> list[str]:
        own = ["id", "lab"] + (["src", "dst"] if self.kind == "edge" else [])
        return [f"{self.slot}_{c}" for c in own] + [f"{self.slot}_p_{p}" for p in self.props]


def common_props(tables: list[ElementTable], wanted: set[str] | None) -> dict[str, tuple[str, T.DataType]]:
    """Properties of a choice of tables with a type that holds the values of all."""
    out: dict[str, tuple[str, T.DataType]] = {}
    for t in tables:
        for p, column in t.props.items():
            if wanted is not None and p not in wanted:
                continue
            new = t.type_of(p)
            if p not in out:
                out[p] = (column, new)
            elif out[p][1] != new:
                a, b = kind_of(out[p][1]), kind_of(new)
                if a in NUMBERS and b in NUMBERS:
                    k = max(a, b, key=NUMBERS.index)
                    new = {"int": T.LongType(), "float": T.DoubleType(), "decimal": T.DecimalType(38, 12)}[k]
                elif a != b:
                    raise BindError(f"property {column} has different types in different tables: {a} and {b}")
                out[p] = (out[p][0], new)
    return out


def scan(b: Bound, identity: bool = True) -> DataFrame:
    """The union of a variable's tables under its columns' names."""
    parts = []
    for i, t in enumerate(b.tables):
        columns = []
        if b.kind == "vertex" or identity:
            columns.append((edge_id(t, i + 1) if b.kind == "edge" else F.col("id")).alias(f"{b.slot}_id"))
        columns.append(F.array(*[F.lit(x) for x in t.labels]).cast("array<string>").alias(f"{b.slot}_lab"))
        if b.kind == "edge":
            columns += [F.col(c).alias(f"{b.slot}_{c}") for c in ("src", "dst")]
        for p, (_, kind) in b.props.items():
            c = F.col(f"`{t.props[p]}`") if p in t.props else F.lit(None)
            columns.append(c.cast(kind).alias(f"{b.slot}_p_{p}"))
        parts.append(t.df.select(*columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def element_struct(b: Bound, at) -> Column:
    """An element as a value: id, (src, dst,) labels and properties; null where the element is."""
    fields = [at("id").alias("id")] + ([at("src").alias("src"), at("dst").alias("dst")] if b.kind == "edge" else [])
    fields.append(at("lab").alias("labels"))
    return F.when(at("id").isNotNull(), F.struct(*fields, *[at(f"p_{p}").alias(name) for p, (name, _) in b.props.items()]))


@dataclass
class Frame(Scope):
    df: DataFrame
    vars: dict[str, Bound] = field(default_factory=dict)
    attached: dict[str, Value] = field(default_factory=dict)
    params: list = field(default_factory=list)
    order: list[str] = field(default_factory=list)  # named variables as declared
    hit: str | None = None  # a column that is null where no match was found

    def bound(self, name: str) -> Bound:
        try:
            return self.vars[name.lower()]
        except KeyError:
            raise BindError(f"unresolved variable {name}") from None

    def single(self, name: str) -> Bound:
        b = self.bound(name)
        if b.path is not None:
            raise BindError(f"group variable {name} must be aggregated")
        return b

    def is_element(self, var: str) -> bool:
        return var.lower() in self.vars

    def _at(self, b: Bound, what: str) -> Column:
        name = f"{b.slot}_{what}"
        if name not in self.df.columns:
            raise BindError(f"{what} of {b.name} can't be used here")
        return F.col(name)

    def variable(self, name: str) -> Value:
        b = self.single(name)
        return Value(element_struct(b, lambda w: self._at(b, w)), b.kind)

    def property(self, var: str, name: str) -> Value:
        b = self.single(var)
        p = name.lower()
        if p not in b.props:
            return Value(F.lit(None), "null")
        return Value(self._at(b, f"p_{p}"), kind_of(b.props[p][1]))

    def identity(self, var: str) -> Column:
        b = self.single(var)
        return self._at(b, "id")

    def labels(self, var: str) -> Column:
        b = self.single(var)
        return self._at(b, "lab")

    def param(self, index: int) -> Value:
        if index >= len(self.params):
            raise BindError(f"parameter {index + 1} has no value")
        return parameter(self.params[index])

    def special(self, n: A.Node) -> Value | None:
        if self.attached and (known := self.attached.get(A.text(n))) is not None:
            return known
        if isinstance(n, A.Aggregate) and is_horizontal(n, self.vars):
            return horizontal(n, self)
        return None

    def function(self, n: A.Call) -> Value:
        if n.name == "MATCH_NUMBER":
            raise BindError("MATCH_NUMBER is of a statement's own matches")
        if n.name == "ELEMENT_NUMBER" and isinstance(n.args[0], A.Var):
            return Value(F.lit(self.single(n.args[0].name).number).cast("long"), "int")
        return super().function(n)


def parameter(v) -> Value:
    """A parameter's value as a literal."""
    import datetime as dt
    from decimal import Decimal

    match v:
        case None:
            return Value(F.lit(None), "null")
        case bool():
            return Value(F.lit(v), "bool")
        case int():
            return Value(F.lit(v).cast("long"), "int")
        case float():
            return Value(F.lit(v).cast("double"), "float")
        case Decimal():
            return literal(A.Literal("decimal", v))
        case str():
            return Value(F.lit(v), "string")
        case bytes() | bytearray():
            return Value(F.lit(bytearray(v)), "bytes")
        case dt.datetime():
            return Value(F.lit(v), "timestamptz") if v.tzinfo else Value(F.lit(v.isoformat(" ")).cast("timestamp_ntz"), "timestamp")
        case dt.date():
            return Value(F.lit(v), "date")
        case dt.time():
            return literal(A.Literal("time", v.isoformat()))
    raise BindError(f"a parameter of type {type(v).__name__}")


# horizontal aggregation: along a path


def group_vars(n: A.Node, vars_: dict[str, Bound]) -> set[str]:
    """Group variables that ``n`` uses outside of aggregates and subqueries."""
    if isinstance(n, (A.Aggregate, A.Select)):
        return set()
    names = {n.name.lower()} if isinstance(n, A.Var) else {n.var.lower()} if isinstance(n, A.Prop) else set()
    out = {v for v in names if v in vars_ and vars_[v].path is not None}
    for c in n.children():
        out |= group_vars(c, vars_)
    return out


def is_horizontal(n: A.Aggregate, vars_: dict[str, Bound]) -> bool:
    return n.arg is not None and bool(group_vars(n.arg, vars_))


class Hop(Scope):
    """One hop of a path: group variables are fields of a struct; other names mean what they mean outside."""

    def __init__(self, outer: Frame, hop: Column, path: str, index: Column | None = None):
        self.outer, self.hop, self.path, self.index = outer, hop, path, index

    def _bound(self, var: str) -> Bound | None:
        b = self.outer.bound(var)
        return b if b.path == self.path else None

    def is_element(self, var: str) -> bool:
        return self.outer.is_element(var)

    def variable(self, name: str) -> Value:
        if (b := self._bound(name)) is None:
            return self.outer.variable(name)
        return Value(element_struct(b, lambda w: self.hop[f"{b.slot}_{w}"]), b.kind)

    def property(self, var: str, name: str) -> Value:
        if (b := self._bound(var)) is None:
            return self.outer.property(var, name)
        p = name.lower()
        return Value(self.hop[f"{b.slot}_p_{p}"], kind_of(b.props[p][1])) if p in b.props else Value(F.lit(None), "null")

    def identity(self, var: str) -> Column:
        return self.outer.identity(var) if (b := self._bound(var)) is None else self.hop[f"{b.slot}_id"]

    def labels(self, var: str) -> Column:
        return self.outer.labels(var) if (b := self._bound(var)) is None else self.hop[f"{b.slot}_lab"]

    def param(self, index: int) -> Value:
        return self.outer.param(index)

    def function(self, n: A.Call) -> Value:
        if n.name == "ELEMENT_NUMBER" and isinstance(n.args[0], A.Var) and self.index is not None and (b := self._bound(n.args[0].name)) is not None:
            return Value((2 * self.index + b.number).cast("long"), "int")
        return self.outer.function(n)


def horizontal(n: A.Aggregate, frame: Frame) -> Value:
    """An aggregate over the hops of one path."""
    paths = {frame.vars[v].path for v in group_vars(n.arg, frame.vars)}
    if len(paths) > 1:
        raise BindError(f"{n} mixes group variables of different paths")
    path = paths.pop()
    kinds: list[str] = []

    def each(h: Column, i: Column) -> Column:
        scope = Hop(frame, h, path, i)
        if isinstance(n.arg, A.Var) and n.name != "ARRAY_AGG":
            kinds.append("int")
            return scope.identity(n.arg.name)
        v = bind(n.arg, scope)
        kinds.append(v.type)
        return text_value(v) if n.name == "LISTAGG" else v.col

    values = F.filter(F.transform(F.col(path), each), lambda x: x.isNotNull())
    if n.distinct:
        values = F.array_distinct(values)
    kind = kinds[0]
    match n.name:
        case "COUNT":
            return Value(F.size(values).cast("long"), "int")
        case "ARRAY_AGG":
            return Value(values, "array")
        case "LISTAGG":
            return Value(F.when(F.size(values) > 0, F.array_join(values, n.separator if n.separator is not None else "")), "string")
        case "MIN":
            return Value(F.array_min(values), kind)
        case "MAX":
            return Value(F.array_max(values), kind)
    if kind not in NUMBERS:
        raise BindError(f"cannot evaluate {n.name} on {kind}")
    wide = {"int": "bigint", "float": "double", "decimal": "decimal(38,12)"}[kind]
    total = F.reduce(values, F.lit(0).cast(wide), lambda a, x: (a + x.cast(wide)).cast(wide))
    if n.name == "SUM":
        return Value(F.when(F.size(values) > 0, total), kind)
    return Value(F.when(F.size(values) > 0, total.cast("double") / F.size(values)), "float")
