"""Bound expressions: syntax trees to Spark columns with their types.

Numbers are promoted Int < Float < Decimal; integer division truncates; NULL conditions count as not met. A scope says
what a variable's properties, id and labels are; aggregates and subqueries have been replaced by columns before.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.lang import ast as A
from pathloom.lang.errors import BindError

NUMBERS = ("int", "float", "decimal")
TIMES = ("date", "time", "timetz", "timestamp", "timestamptz")
DAY_MICROS = 86_400_000_000


@dataclass
class Value:
    """A column and its type: int float decimal string bytes bool date time timetz timestamp timestamptz months seconds
    (intervals), vertex, edge, array, null or other."""

    col: Column
    type: str


def kind_of(t: T.DataType) -> str:
    match t:
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return "int"
        case T.FloatType() | T.DoubleType():
            return "float"
        case T.DecimalType():
            return "decimal"
        case T.StringType() | T.CharType() | T.VarcharType():
            return "string"
        case T.BinaryType():
            return "bytes"
        case T.BooleanType():
            return "bool"
        case T.DateType():
            return "date"
        case T.TimestampNTZType():
            return "timestamp"
        case T.TimestampType():
            return "timestamptz"
        case T.YearMonthIntervalType():
            return "months"
        case T.DayTimeIntervalType():
            return "seconds"
        case T.ArrayType():
            return "array"
        case T.NullType():
            return "null"
    if type(t).__name__ == "TimeType":
        return "time"
    if isinstance(t, T.StructType) and t.names == ["time", "offset"]:
        return "timetz"
    return "other"


def zone_seconds(text: str) -> int:
    """Seconds of an offset such as +01:00 or -07:30; at most 14 hours."""
    m = re.fullmatch(r"([+-])(\d\d):?(\d\d)", text)
    if not m or int(m[3]) > 59 or int(m[2]) * 60 + int(m[3]) > 840:
        raise BindError(f"invalid time zone {text!r}")
    return (1 if m[1] == "+" else -1) * (int(m[2]) * 3600 + int(m[3]) * 60)


def _wall(text: str, kind: str) -> tuple[str, str | None]:
    m = re.fullmatch(r"(.*?:\d\d(?:\.\d+)?)\s*([+-]\d\d:?\d\d)?", text)
    if not m:
        raise BindError(f"invalid {kind} {text!r}")
    return m[1], m[2]


def literal(n: A.Literal) -> Value:
    v = n.value
    try:
        match n.kind:
            case "int":
                return Value(F.lit(v).cast("long"), "int")
            case "float":
                return Value(F.lit(v).cast("double"), "float")
            case "decimal":
                digits = max(len(v.as_tuple().digits), -v.as_tuple().exponent, 1)
                if digits > 38:
                    raise BindError(f"more than 38 digits: {v}")
                return Value(F.lit(v).cast(T.DecimalType(digits, max(0, -v.as_tuple().exponent))), "decimal")
            case "string":
                return Value(F.lit(v), "string")
            case "bytes":
                return Value(F.lit(bytearray(v)), "bytes")
            case "bool":
                return Value(F.lit(v), "bool")
            case "null":
                return Value(F.lit(None), "null")
            case "date":
                return Value(F.lit(dt.date.fromisoformat(v)), "date")
            case "time":
                wall, zone = _wall(v, "TIME")
                dt.time.fromisoformat(wall)
                t = F.lit(wall).cast("time(6)")
                return Value(t, "time") if zone is None else Value(F.struct(t.alias("time"), F.lit(zone_seconds(zone)).alias("offset")), "timetz")
            case "timestamp":
                wall, zone = _wall(v, "TIMESTAMP")
                dt.datetime.fromisoformat(wall)
                if zone is None:
                    return Value(F.lit(wall).cast("timestamp_ntz"), "timestamp")
                zone_seconds(zone)
                return Value(F.to_timestamp(F.lit(f"{wall}{zone}")), "timestamptz")
    except ValueError as e:
        raise BindError(f"invalid {n.kind.upper()} {v!r}: {e}") from None
    raise BindError(f"literal {n}")


def promote(op: str, a: Value, b: Value) -> tuple[Column, Column, str]:
    """Both sides as the wider of their types."""
    if a.type == "null" or b.type == "null":
        t = b.type if a.type == "null" else a.type
        return a.col, b.col, t if t in NUMBERS else "int"
    if a.type not in NUMBERS or b.type not in NUMBERS:
        raise BindError(f"cannot evaluate {op} on {a.type} and {b.type}")
    t = max(a.type, b.type, key=NUMBERS.index)
    return number_as(a, t), number_as(b, t), t


def number_as(v: Value, t: str) -> Column:
    if v.type == t or v.type == "null":
        return v.col
    if t == "float":
        return v.col.cast("double")
    return v.col.cast(T.DecimalType(38, 12) if v.type == "float" else T.DecimalType(19, 0))


def _time_micros(v: Value) -> Column:
    """Microseconds since midnight; for a time with zone, of UTC (may be negative or above a day)."""
    t = v.col if v.type == "time" else v.col["time"]
    micros = (F.hour(t).cast("long") * 3600 + F.minute(t).cast("long") * 60) * 1_000_000 + (F.expr("1000000") * F.extract(F.lit("SECOND"), t)).cast("long")
    return micros if v.type == "time" else micros - v.col["offset"].cast("long") * 1_000_000


def _time_of(micros: Column) -> Column:
    m = F.pmod(micros, F.lit(DAY_MICROS))
    second = (F.pmod(m, F.lit(60_000_000)).cast("decimal(18,6)") / F.lit(1_000_000).cast("decimal(18,0)")).cast("decimal(16,6)")
    return F.make_time((m / F.lit(3_600_000_000)).cast("int"), F.pmod((m / F.lit(60_000_000)).cast("int"), F.lit(60)), second)


def interval(amount: Value, unit: str) -> Value:
    if amount.type not in NUMBERS:
        raise BindError(f"an interval of {amount.type}")
    n = amount.col
    if unit in ("YEAR", "MONTH"):
        whole = n.cast("int")
        return Value(F.make_ym_interval(whole) if unit == "YEAR" else F.make_ym_interval(F.lit(0), whole), "months")
    at = {"DAY": 0, "HOUR": 1, "MINUTE": 2, "SECOND": 3}[unit]
    parts = [F.lit(0)] * at + [n.cast("int") if unit != "SECOND" else n.cast("decimal(18,6)")]
    return Value(F.make_dt_interval(*parts), "seconds")


def _shift(op: str, a: Value, b: Value) -> Value | None:
    """Dates and times with intervals; None if these aren't such."""
    if op == "+" and a.type in ("months", "seconds") and b.type in TIMES:
        a, b = b, a
    if op not in "+-" or b.type not in ("months", "seconds"):
        return None
    sign = 1 if op == "+" else -1
    if a.type in ("months", "seconds"):
        return Value(a.col + b.col if sign > 0 else a.col - b.col, a.type) if a.type == b.type else None
    if a.type not in TIMES:
        return None
    if a.type in ("time", "timetz"):
        if b.type == "months":
            raise BindError(f"cannot evaluate {op} on {a.type} and months")
        micros = F.expr("0L") + (F.extract(F.lit("DAY"), b.col).cast("long") * DAY_MICROS + F.extract(F.lit("HOUR"), b.col).cast("long") * 3_600_000_000 + F.extract(F.lit("MINUTE"), b.col).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), b.col) * 1_000_000).cast("long"))
        local = Value(a.col if a.type == "time" else a.col["time"], "time")
        moved = _time_of(_time_micros(local) + sign * micros)
        return Value(moved if a.type == "time" else F.struct(moved.alias("time"), a.col["offset"].alias("offset")), a.type)
    moved = a.col + b.col if sign > 0 else a.col - b.col
    return Value(moved.cast("date") if a.type == "date" else moved, a.type)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if (shifted := _shift(op, a, b)) is not None:
        return shifted
    x, y, t = promote(op, a, b)
    if op == "/" and t == "int":
        return Value(F.call_function("div", x.cast("long"), y.cast("long")), t)
    if op == "/" and t == "decimal":
        return Value((x.cast(T.DecimalType(38, 12)) / y.cast(T.DecimalType(38, 12))), t)
    if t == "int":
        x, y = x.cast("long"), y.cast("long")
    return Value({"+": x + y, "-": x - y, "*": x * y, "/": x / y, "%": x % y}[op], t)


def comparison(op: str, a: Value, b: Value) -> Value:
    x, y = a.col, b.col
    if {a.type, b.type} <= {"vertex", "edge"} and op in ("=", "<>"):
        pass  # ids, by the caller
    elif a.type in NUMBERS and b.type in NUMBERS:
        x, y, _ = promote(op, a, b)
    elif {a.type, b.type} == {"string", "bytes"}:
        x, y = x.cast("binary"), y.cast("binary")
    elif a.type in ("time", "timetz") and b.type in ("time", "timetz"):
        if a.type != b.type or a.type == "timetz":
            x, y = _time_micros(a), _time_micros(b)
    elif {a.type, b.type} <= {"date", "timestamp", "timestamptz"}:
        if a.type != b.type:
            kind = "timestamp" if "timestamptz" in (a.type, b.type) else "timestamp_ntz"
            x, y = x.cast(kind), y.cast(kind)
    elif a.type != b.type and "null" not in (a.type, b.type):
        raise BindError(f"cannot evaluate {op} on {a.type} and {b.type}")
    elif a.type in ("vertex", "edge", "other") and op not in ("=", "<>"):
        raise BindError(f"cannot evaluate {op} on {a.type} and {b.type}")
    return Value({"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")


def truth(v: Value, what: str) -> Column:
    if v.type == "null":
        return F.lit(None).cast("boolean")
    if v.type != "bool":
        raise BindError(f"cannot evaluate {what} on {v.type}")
    return v.col


def text_value(v: Value) -> Column:
    if v.type == "timetz":
        off = F.abs(v.col["offset"])
        return F.concat(v.col["time"].cast("string"), F.when(v.col["offset"] < 0, "-").otherwise("+"), F.format_string("%02d:%02d", (off / 3600).cast("int"), F.pmod((off / 60).cast("int"), F.lit(60))))
    return v.col.cast("string")


def common(values: list[Value], what: str) -> tuple[list[Column], str]:
    """Values of a CASE or a list as one type."""
    known = [v for v in values if v.type != "null"]
    if not known:
        return [v.col for v in values], "null"
    if all(v.type in NUMBERS for v in known):
        t = max((v.type for v in known), key=NUMBERS.index)
        return [number_as(v, t) if v.type != "null" else v.col for v in values], t
    if len({v.type for v in known}) > 1:
        raise BindError(f"{what} of different types: {', '.join(sorted({v.type for v in known}))}")
    return [v.col for v in values], known[0].type


CASTS = {"STRING": ("string", "string"), "BOOLEAN": ("boolean", "bool"), "INTEGER": ("bigint", "int"), "LONG": ("bigint", "int"), "FLOAT": ("float", "float"), "DOUBLE": ("double", "float"), "DATE": ("date", "date"), "TIMESTAMP": ("timestamp_ntz", "timestamp"), "TIMESTAMP WITH TIME ZONE": ("timestamp", "timestamptz")}


def cast(v: Value, to: str) -> Value:
    if to == "STRING":
        return Value(text_value(v), "string")
    if to == "DECIMAL":
        return Value(v.col.cast("decimal(38,12)"), "decimal")
    if to == "TIME":
        if v.type == "timetz":
            return Value(v.col["time"], "time")
        if v.type in ("timestamp", "timestamptz"):
            c = v.col.cast("timestamp_ntz")
            return Value(F.make_time(F.hour(c), F.minute(c), F.extract(F.lit("SECOND"), c).cast("decimal(16,6)")), "time")
        return Value(v.col.cast("time(6)"), "time")
    if to == "TIME WITH TIME ZONE":
        if v.type == "timetz":
            return v
        zone = F.regexp_extract(v.col.cast("string"), r"([+-]\d\d:?\d\d)$", 1) if v.type == "string" else F.lit("")
        wall = F.regexp_replace(v.col.cast("string"), r"\s*[+-]\d\d:?\d\d$", "") if v.type == "string" else v.col
        digits = F.regexp_replace(zone, ":", "")
        seconds = F.when(zone == "", 0).otherwise((F.substring(digits, 2, 2).try_cast("int") * 3600 + F.substring(digits, 4, 2).try_cast("int") * 60) * F.when(F.startswith(digits, F.lit("-")), -1).otherwise(1))
        return Value(F.struct(wall.cast("time(6)").alias("time"), F.coalesce(seconds, F.lit(0)).alias("offset")), "timetz")
    spark_type, kind = CASTS[to]
    if v.type in ("time", "timetz") or v.type in ("vertex", "edge", "array"):
        raise BindError(f"cannot cast {v.type} to {to}")
    return Value(v.col.cast(spark_type), kind)


def extract(part: str, v: Value) -> Value:
    if v.type not in TIMES:
        raise BindError(f"cannot extract {part} from {v.type}")
    if part in ("TIMEZONE_HOUR", "TIMEZONE_MINUTE"):
        if v.type == "timetz":
            off = v.col["offset"].cast("long")
        elif v.type == "timestamptz":  # the instant's offset in the session's zone
            off = F.unix_timestamp(v.col.cast("timestamp_ntz").cast("timestamp")) * 0 + (F.unix_seconds(F.convert_timezone(F.current_timezone(), F.lit("UTC"), v.col.cast("timestamp_ntz")).cast("timestamp")) - F.unix_seconds(v.col)) * -1
        else:
            raise BindError(f"cannot extract {part} from {v.type}")
        return Value(F.call_function("div", off, F.lit(3600).cast("long")) if part == "TIMEZONE_HOUR" else F.call_function("div", off % 3600, F.lit(60).cast("long")), "int")
    date_part = part in ("YEAR", "MONTH", "DAY")
    if date_part and v.type in ("time", "timetz") or not date_part and v.type == "date":
        raise BindError(f"cannot extract {part} from {v.type}")
    c = v.col["time"] if v.type == "timetz" else v.col
    got = F.extract(F.lit(part), c)
    return Value(got, "decimal") if part == "SECOND" else Value(got.cast("long"), "int")


class Scope:
    """What names mean; subclassed by the statements' operators."""

    def variable(self, name: str) -> Value:
        raise BindError(f"unresolved variable {name}")

    def property(self, var: str, name: str) -> Value:
        raise BindError(f"unresolved variable {var}")

    def identity(self, var: str) -> Column:
        """The id of an element."""
        raise BindError(f"unresolved variable {var}")

    def labels(self, var: str) -> Column:
        raise BindError(f"unresolved variable {var}")

    def is_element(self, var: str) -> bool:
        return False

    def special(self, n: A.Node) -> Value | None:
        """Values of nodes that have been computed: aggregates, subqueries, grouped expressions."""
        return None

    def function(self, n: A.Call) -> Value:
        raise BindError(f"{n.name} can't be used here")

    def param(self, index: int) -> Value:
        raise BindError("a parameter has no value")


def bind(n: A.Node, scope: Scope) -> Value:
    """The column of an expression."""
    if (known := scope.special(n)) is not None:
        return known

    def sub(x: A.Node) -> Value:
        return bind(x, scope)

    match n:
        case A.Literal():
            return literal(n)
        case A.Paren(x):
            return sub(x)
        case A.Param(i):
            return scope.param(i)
        case A.Interval(x, unit):
            return interval(sub(x), unit)
        case A.Var(v):
            return scope.variable(v)
        case A.Prop(v, p):
            return scope.property(v, p)
        case A.Unary("NOT", x):
            return Value(~truth(sub(x), "NOT"), "bool")
        case A.Unary(_, x):
            v = sub(x)
            if v.type not in (*NUMBERS, "months", "seconds", "null"):
                raise BindError(f"cannot evaluate - on {v.type}")
            return Value(-v.col, v.type)
        case A.Binary("AND" | "OR" | "XOR" as op, x, y):
            a, b = truth(sub(x), op), truth(sub(y), op)
            return Value(a & b if op == "AND" else a | b if op == "OR" else a != b, "bool")
        case A.Binary("||", x, y):
            return Value(F.concat(text_value(sub(x)), text_value(sub(y))), "string")
        case A.Binary("=" | "<>" | "<" | "<=" | ">" | ">=" as op, x, y):
            a, b = element(x, scope), element(y, scope)
            if a is not None and b is not None:
                if op not in ("=", "<>"):
                    raise BindError(f"cannot evaluate {op} on elements")
                return Value(a == b if op == "=" else a != b, "bool")
            return comparison(op, sub(x), sub(y))
        case A.Binary(op, x, y):
            return arithmetic(op, sub(x), sub(y))
        case A.IsNull(x, negated):
            c = element(x, scope)
            c = sub(x).col if c is None else c
            return Value(c.isNotNull() if negated else c.isNull(), "bool")
        case A.Cast(x, to):
            return cast(sub(x), to)
        case A.Case(operand, whens, default):
            conditions = [comparison("=", sub(operand), sub(c)).col if operand is not None else truth(sub(c), "CASE") for c, _ in whens]
            columns, t = common([*(sub(v) for _, v in whens), sub(default) if default is not None else Value(F.lit(None), "null")], "CASE")
            out = F.when(conditions[0], columns[0])
            for c, v in zip(conditions[1:], columns[1:-1]):
                out = out.when(c, v)
            return Value(out.otherwise(columns[-1]), t)
        case A.In(x, items, negated):
            a = sub(x)
            found = None
            for i in items:
                c = comparison("=", a, sub(i)).col
                found = c if found is None else found | c
            return Value(~found if negated else found, "bool")
        case A.Extract(part, x):
            return extract(part, sub(x))
        case A.Substring(x, start, length):
            c, s = text_value(sub(x)), sub(start).col.cast("int")
            return Value(F.substring(c, s, sub(length).col.cast("int") if length is not None else F.lit(2**31 - 1)), "string")
        case A.Call():
            return call(n, scope)
        case A.Aggregate():
            raise BindError(f"{n} can't be used here")
    raise BindError(f"{n} can't be used here")


def element(n: A.Node, scope: Scope) -> Column | None:
    """The id, if ``n`` is a variable that stands for an element."""
    while isinstance(n, A.Paren):
        n = n.arg
    return scope.identity(n.name) if isinstance(n, A.Var) and scope.special(n) is None and scope.is_element(n.name) else None


def call(n: A.Call, scope: Scope) -> Value:
    def var(x: A.Node) -> str:
        while isinstance(x, A.Paren):
            x = x.arg
        if not isinstance(x, A.Var):
            raise BindError(f"{n.name} takes a variable")
        return x.name

    match n.name:
        case "LOWER" | "UPPER":
            v = bind(n.args[0], scope)
            if v.type not in ("string", "null"):
                raise BindError(f"cannot evaluate {n.name} on {v.type}")
            return Value(F.lower(v.col) if n.name == "LOWER" else F.upper(v.col), "string")
        case "JAVA_REGEXP_LIKE":
            return Value(F.rlike(text_value(bind(n.args[0], scope)), text_value(bind(n.args[1], scope))), "bool")
        case "ABS" | "CEIL" | "FLOOR":
            v = bind(n.args[0], scope)
            if v.type not in (*NUMBERS, "null"):
                raise BindError(f"cannot evaluate {n.name} on {v.type}")
            c = {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor}[n.name](v.col)
            return Value(c.cast("double") if v.type == "float" else c.cast("long") if v.type == "int" else c, v.type)
        case "ID":
            return Value(scope.identity(var(n.args[0])), "int")
        case "LABEL":
            return Value(F.get(scope.labels(var(n.args[0])), 0), "string")
        case "LABELS":
            return Value(scope.labels(var(n.args[0])), "array")
        case "HAS_LABEL":
            wanted = F.lower(text_value(bind(n.args[1], scope)))
            return Value(F.exists(scope.labels(var(n.args[0])), lambda x: F.lower(x) == wanted), "bool")
        case "ALL_DIFFERENT":
            ids = [element(x, scope) for x in n.args]
            if all(i is None for i in ids):
                ids, _ = common([bind(x, scope) for x in n.args], "ALL_DIFFERENT")
            elif any(i is None for i in ids):
                raise BindError("ALL_DIFFERENT takes elements or values, not both")
            return Value(F.size(F.array_distinct(F.array(*ids))) == len(ids), "bool")
    return scope.function(n)


def plain(v: Value) -> Column:
    return v.col


Binder = Callable[[A.Node], Value]
