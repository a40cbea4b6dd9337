"""Expressions of the script language as typed Spark columns.

``compile_expression(text, env)`` takes a type for each variable, so that the
whole expression is one Catalyst expression.  Types are null, bool, long, double
and string; a string beside a number is read as a double.  Combinations that the
language refuses are refused when compiling; bad text at run time raises.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .language import ScriptError, parse_expression


class Typed(NamedTuple):
    kind: str
    col: Column
    revision: Column | None = None
    expires: Column | None = None


SPARK = {"null": "string", "bool": "boolean", "long": "bigint", "double": "double", "string": "string"}


def literal(v) -> Typed:
    kind = "null" if v is None else {bool: "bool", int: "long", float: "double", str: "string"}[type(v)]
    return Typed(kind, F.lit(v).cast(SPARK[kind]))


def _number(x: Typed) -> Typed:
    if x.kind == "string":
        bad = F.raise_error(F.concat(F.lit("no number: "), x.col))
        return Typed("double", F.when(x.col.isNotNull(), F.coalesce(x.col.try_cast("double"), bad.cast("double"))))
    if x.kind not in ("long", "double"):
        raise ScriptError(f"a number is expected, not {x.kind}")
    return x


def _pair(op: str, a: Typed, b: Typed) -> tuple[Typed, Typed]:
    if a.kind == b.kind == "string":
        raise ScriptError(f"{op} of string and string")
    return _number(a), _number(b)


def _equal(a: Typed, b: Typed) -> Column:
    if "null" in (a.kind, b.kind):
        return F.lit(True) if a.kind == b.kind else (b if a.kind == "null" else a).col.isNull()
    if (a.kind == "bool") != (b.kind == "bool"):
        raise ScriptError(f"= of {a.kind} and {b.kind}")
    if a.kind == b.kind and a.kind in ("string", "bool", "long"):
        return a.col.eqNullSafe(b.col)
    x, y = _number(a), _number(b)
    near = F.abs(x.col.cast("double") - y.col.cast("double")) <= 0.001 if "double" in (x.kind, y.kind) else x.col == y.col
    return F.coalesce(near, a.col.isNull() & b.col.isNull())


def _binary(op: str, a: Typed, b: Typed) -> Typed:
    if op in ("=", "<>"):
        e = _equal(a, b)
        return Typed("bool", e if op == "=" else ~e)
    if op in ("&&", "||"):
        if (a.kind == "bool") != (b.kind == "bool") or not {a.kind, b.kind} <= {"bool", "long", "double"}:
            raise ScriptError(f"{op} of {a.kind} and {b.kind}")
        x, y = (v.col if v.kind == "bool" else v.col != 0 for v in (a, b))
        return Typed("bool", x & y if op == "&&" else x | y)
    a, b = _pair(op, a, b)
    if op in ("<", ">", "<=", ">="):
        x, y = a.col, b.col
        return Typed("bool", {"<": x < y, ">": x > y, "<=": ~(x > y), ">=": ~(x < y)}[op])
    whole = a.kind == b.kind == "long"
    if op == "/":
        if whole:
            return Typed("long", F.call_function("div", a.col, b.col))
        x, y = a.col.cast("double"), b.col.cast("double")
        zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return Typed("double", F.when(y == 0, zero).otherwise(F.try_divide(x, y)))
    if whole:
        return Typed("long", _wrapping(op, a.col, b.col))
    x, y = a.col.cast("double"), b.col.cast("double")
    return Typed("double", {"+": x + y, "-": x - y, "*": x * y}[op])


def _wrapping(op: str, a: Column, b: Column) -> Column:
    """64-bit arithmetic; a result beyond 64 bits wraps around."""
    x, y = a.cast("decimal(19,0)"), b.cast("decimal(19,0)")
    exact = {"+": x + y, "-": x - y, "*": x * y}[op].cast("decimal(38,0)")
    size, half = F.lit(str(2**64)).cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(19,0)")
    low = F.pmod(exact, size)
    wrapped = F.when(low >= half, low - size).otherwise(low).cast("bigint")
    return F.coalesce({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b), wrapped)


def text(x: Typed) -> Column:
    """The value as stored."""
    if x.kind == "null":
        return F.lit("")
    if x.kind == "double":
        whole = (x.col == F.floor(x.col)) & (F.abs(x.col) < 1e15)
        return F.coalesce(F.when(whole, x.col.cast("decimal(20,0)").cast("string")).otherwise(x.col.cast("string")), F.lit(""))
    return F.coalesce(x.col.cast("string"), F.lit(""))


def _call(name: str, args: list[Typed], now_l: int | None) -> Typed:
    def need(n: int, *kinds: str) -> None:
        if len(args) != n:
            raise ScriptError(f"{name} takes {n} arguments")
        for a in args:
            if kinds and a.kind not in kinds:
                raise ScriptError(f"{name} of {a.kind}")

    if name == "current_time":
        need(0)
        return Typed("long", F.lit(now_l).cast("bigint"))
    if not args:
        raise ScriptError(f"{name} takes arguments")
    a = args[0]
    num = ("long", "double")
    if name == "abs":
        need(1, *num)
        return Typed(a.kind, F.abs(a.col))
    if name == "pow":
        need(2, *num)
        return Typed("double", F.pow(a.col, args[1].col))
    if name == "round":
        need(2, *num)
        # bankers' rounding by halves of the scaled value; the places may be a column
        scale = F.pow(F.lit(10.0), args[1].col)
        return Typed("double", F.rint(a.col.cast("double") * scale) / scale)
    if name in ("ceil", "floor"):
        need(1, *num)
        return Typed("double", (F.ceil if name == "ceil" else F.floor)(a.col).cast("double"))
    if name in ("min", "max"):
        need(2, *num)
        kind = a.kind if a.kind == args[1].kind else "double"
        return Typed(kind, (F.least if name == "min" else F.greatest)(*[x.col.cast(SPARK[kind]) for x in args]))
    if name in ("to_int", "to_integer", "to_long", "to_number"):
        need(1)
        if a.kind == "string":
            return Typed("long", F.when(F.coalesce(a.col, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(a.col.cast("bigint")))
        return Typed("long", F.lit(0).cast("bigint") if a.kind == "null" else a.col.cast("bigint"))
    if name in ("to_float", "to_double"):
        need(1)
        if a.kind == "string":
            return Typed("double", F.when(F.coalesce(a.col, F.lit("")) == "", F.lit(0.0)).otherwise(a.col.cast("double")))
        return Typed("double", F.lit(0.0) if a.kind == "null" else a.col.cast("double"))
    if name in ("to_str", "to_string"):
        need(1)
        return Typed("string", text(a))
    if name in ("to_bool", "to_boolean"):
        need(1)
        if a.kind == "string":
            return Typed("bool", F.coalesce(F.lower(a.col) == "true", F.lit(False)))
        return Typed("bool", F.lit(False) if a.kind == "null" else a.col if a.kind == "bool" else a.col != 0)
    tests = {"int": "long", "integer": "long", "long": "long", "float": "double", "double": "double", "str": "string", "string": "string", "bool": "bool", "boolean": "bool", "array": "array"}
    if name.startswith("is_") and name[3:] in tests:
        need(1)
        return Typed("bool", (a.col.isNotNull() if a.revision is not None else F.lit(True)) if a.kind == tests[name[3:]] else F.lit(False))
    if name == "is_null":
        need(1)
        return Typed("bool", F.lit(True) if a.kind == "null" else a.col.isNull())
    if name == "to_json":
        need(1, "long", "double", "string")
        if a.kind == "string":
            return Typed("string", F.regexp_replace(F.to_json(F.array(a.col)), r"^\[|\]$", ""))
        return Typed("string", a.col.cast("string"))
    if name == "concat":
        need(2, "string")
        return Typed("string", F.concat(a.col, args[1].col))
    if name in ("upper", "lower"):
        need(1, "string")
        return Typed("string", (F.upper if name == "upper" else F.lower)(a.col))
    if name in ("len", "length"):
        need(1, "string")
        return Typed("long", F.length(a.col).cast("bigint"))
    if name == "count":
        need(1, "array")
        return Typed("long", F.size(a.col).cast("bigint"))
    if name in ("revision", "rev"):
        need(1)
        return Typed("long", (a.revision if a.revision is not None else F.lit(-1)).cast("bigint"))
    if name == "expires":
        need(1)
        return Typed("long", (a.expires if a.expires is not None else F.lit(0)).cast("bigint"))
    raise ScriptError(f"no function {name}")


def compile_node(node: tuple, env: dict[str, Typed], now_l: int | None = None) -> Typed:
    if node[0] == "lit":
        return literal(node[1])
    if node[0] in ("var", "param"):
        if node[1] not in env:
            raise ScriptError(f"{node[1]} is not bound")
        return env[node[1]]
    if node[0] == "op" and node[1] == "..":
        a, b = (compile_node(x, env, now_l) for x in node[2:])
        if (a.kind, b.kind) != ("long", "long"):
            raise ScriptError(".. takes two integers")
        none = F.array().cast("array<bigint>")
        return Typed("array", F.when(b.col > 0, F.sequence(a.col, a.col + F.greatest(b.col, F.lit(1)) - 1)).otherwise(none))
    if node[0] == "op":
        return _binary(node[1], compile_node(node[2], env, now_l), compile_node(node[3], env, now_l))
    if node[0] == "not":
        a = compile_node(node[1], env, now_l)
        if a.kind not in ("bool", "long", "double"):
            raise ScriptError(f"not of {a.kind}")
        return Typed("bool", ~a.col if a.kind == "bool" else a.col != 0)
    if node[0] == "index":
        a, i = (compile_node(x, env, now_l) for x in node[1:])
        if (a.kind, i.kind) != ("array", "long"):
            raise ScriptError("an index is an integer, and what it is of an array")
        ok = (i.col >= 0) & (i.col < F.size(a.col))
        return Typed("long", F.when(ok, F.get(a.col, i.col.cast("int"))).otherwise(F.raise_error(F.lit("index out of bounds")).cast("bigint")))
    if node[0] == "call":
        return _call(node[1], [compile_node(x, env, now_l) for x in node[2]], now_l)
    raise ScriptError(f"{node[0]} is not an expression of rows")


def compile_expression(text_: str, env: dict[str, Typed], now_l: int | None = None) -> Typed:
    return compile_node(parse_expression(text_), env, now_l)
