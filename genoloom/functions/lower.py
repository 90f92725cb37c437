"""Syntax trees of expressions to typed columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from genoloom.functions.registry import FUNCTIONS, ieee_divide
from genoloom.functions.values import Value, choice, each, either, truthy
from genoloom.lang import ast

NULL = "null"


@dataclass
class Scope:
    """What names mean: fields (name to column and type) and bound variables."""

    fields: dict = field(default_factory=dict)
    variables: dict = field(default_factory=dict)


def literal(v) -> Value:
    if v is None:
        return Value(F.lit(None), NULL)
    if isinstance(v, bool):
        return Value(F.lit(v), "bool")
    if isinstance(v, int):
        return Value(F.lit(v).cast("long"), "int")
    if isinstance(v, float):
        return Value(F.lit(v), "float")
    return Value(F.lit(str(v)), "str")


def wrapped(op: str, x, y):
    """Whole numbers with wrap-around: the plain result, or the one modulo 2**64."""
    plain = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
    a, b = x.cast("decimal(19,0)"), y.cast("decimal(19,0)")
    exact = a + b if op == "+" else a - b if op == "-" else a * b
    size, half = F.lit(str(2**64)).cast("decimal(38,0)"), F.lit(str(2**63)).cast("decimal(38,0)")
    low = F.pmod(exact.cast("decimal(38,0)"), size)
    return F.coalesce(plain, F.when(low >= half, low - size).otherwise(low).cast("long"))


def lower(e, scope: Scope) -> Value:
    if isinstance(e, ast.Lit):
        return literal(e.value)
    if isinstance(e, ast.Name):
        found = scope.fields.get(e.name)
        return Value(found[0], found[1]) if found else Value(F.lit(None), NULL)
    if isinstance(e, ast.Var):
        if e.name not in scope.variables:
            return Value(F.lit(None), NULL, True)
        return literal(scope.variables[e.name])
    if isinstance(e, (ast.Field, ast.Star)):
        return Value(F.lit(None), NULL)
    if isinstance(e, ast.Call):
        return FUNCTIONS[e.name.lower()].lower([lower(a, scope) for a in e.args])
    if isinstance(e, ast.Unary):
        return unary(e.op, lower(e.arg, scope))
    left, right = lower(e.left, scope), lower(e.right, scope)
    if e.op in ("AND", "OR"):
        return logic(e.op, left, right)
    return binary(e.op, left, right)


def unary(op: str, x: Value) -> Value:
    if x.type == "any":
        return each(x, "bool" if op == "NOT" else "float", lambda v: unary(op, v))
    if op == "NOT":
        if x.type == NULL:
            return Value(F.lit(True), "bool", x.err)
        return Value(F.coalesce(~x.col, F.lit(True)), "bool", x.err) if x.type == "bool" else Value(F.lit(None).cast("boolean"), "bool", True)
    if x.type not in ("int", "float"):
        return Value(F.lit(None).cast("double"), "float", True)
    err = either(x.err, x.col.isNull())
    return Value(wrapped("-", F.lit(0).cast("long"), x.col) if x.type == "int" else -x.col, x.type, err)


def binary(op: str, left: Value, right: Value) -> Value:
    """Comparison and arithmetic."""
    if op in ("=", "!="):
        same = equal(left, right)
        return Value(same if op == "=" else ~same, "bool", either(left.err, right.err))
    result = "bool" if op in ("<", ">", "<=", ">=") else "float"
    if left.type == "any":
        return each(left, result, lambda v: binary(op, v, right))
    if right.type == "any":
        return each(right, result, lambda v: binary(op, left, v))
    kinds = {left.type, right.type}
    if not kinds <= {"int", "float"}:
        return Value(F.lit(None).cast("boolean" if op in ("<", ">", "<=", ">=") else "double"), "bool" if op in ("<", ">", "<=", ">=") else "float", True)
    x, y = left.col, right.col
    err = either(left.err, right.err, x.isNull(), y.isNull())
    if kinds != {"int"}:
        x, y = x.cast("double"), y.cast("double")
    if op in ("<", ">", "<=", ">="):
        out = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        if kinds != {"int"}:
            out = out & ~F.isnan(x) & ~F.isnan(y)
        return Value(out, "bool", err)
    if kinds == {"int"}:
        if op == "/":
            # truncates; the least long by -1 wraps to itself
            cut = F.when(y == -1, wrapped("-", F.lit(0).cast("long"), x)).when((y != 0) & (y != -1), F.call_function("div", x, F.when((y != 0) & (y != -1), y)))
            return Value(cut, "int", either(err, y == 0))
        return Value(wrapped(op, x, y), "int", err)
    out = ieee_divide(x, y) if op == "/" else x + y if op == "+" else x - y if op == "-" else x * y
    return Value(out, "float", err)


def equal(a: Value, b: Value):
    """Null equals null; numbers compare as numbers; other types never equal one another; NaN equals nothing."""
    if a.type == "any":
        return F.coalesce(each(a, "bool", lambda v: Value(equal(v, b), "bool")).col, equal(Value(F.lit(None), NULL), b))
    if b.type == "any":
        return equal(b, a)
    if NULL in (a.type, b.type):
        return (a if b.type == NULL else b).col.isNull() if a.type != b.type else F.lit(True)
    if a.type == b.type and a.type != "float":
        return a.col.eqNullSafe(b.col)
    if {a.type, b.type} <= {"int", "float"}:
        x, y = a.col.cast("double"), b.col.cast("double")
        return x.eqNullSafe(y) & ~F.coalesce(F.isnan(x), F.lit(False)) & ~F.coalesce(F.isnan(y), F.lit(False))
    return a.col.isNull() & b.col.isNull()


def logic(op: str, a: Value, b: Value) -> Value:
    """The operand that decides, as a value; an error on the right counts only if it is reached."""
    reached = truthy(a) if op == "AND" else ~truthy(a)
    late = b.err if b.err is False else reached if b.err is True else reached & b.err
    err = either(a.err, late)
    return choice([(reached, b), (F.lit(True), a)], err)


def predicate(e, scope: Scope):
    """WHERE as a column: true where the expression is, false where it isn't or fails.

    Conjuncts of the form field-compare-literal are added in plain form too;
    they say the same, and Catalyst can push them into the scan.
    """
    v = lower(e, scope)
    if v.err is True:
        return F.lit(False)
    out = truthy(v) if v.err is False else F.coalesce(truthy(v) & ~v.err, F.lit(False))
    for plain in conjuncts(e, scope):
        out = out & plain
    return out


def conjuncts(e, scope: Scope):
    if isinstance(e, ast.Binary) and e.op == "AND":
        yield from conjuncts(e.left, scope)
        yield from conjuncts(e.right, scope)
    elif isinstance(e, ast.Binary) and e.op in ("=", "<", ">", "<=", ">="):
        name, lit, op = e.left, e.right, e.op
        if isinstance(name, ast.Lit):
            name, lit, op = lit, name, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
        found = scope.fields.get(name.name) if isinstance(name, ast.Name) else None
        if found and isinstance(lit, ast.Lit) and not isinstance(lit.value, bool):
            col, kind = found
            same = kind == "str" and isinstance(lit.value, str) and op == "=" or kind == "int" and isinstance(lit.value, int) or kind == "float" and isinstance(lit.value, (int, float))
            if same:
                yield {"=": col == lit.value, "<": col < lit.value, ">": col > lit.value, "<=": col <= lit.value, ">=": col >= lit.value}[op]
