"""Typed expressions that carry their own error flag.

The language has no exceptions: an error in a row makes WHERE drop it and a
SELECT cell null. ``Value.err`` is a boolean column that is true where an
expression fails, or a Python bool where that is known when planning, so clean
expressions cost nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Value:
    """A typed column. One of several types ("any") is a list of (condition, Value), the first true one counts."""

    col: Column
    type: str  # int, float, str, bool, null or any
    err: object = False  # bool or Column
    choices: tuple = ()


def choice(pairs: list, err=False) -> Value:
    """The first value whose condition holds; null if none does."""
    pairs = [(c & inner, x) for c, v in pairs for inner, x in (v.choices or ((F.lit(True), v),))]
    types = {v.type for _, v in pairs if v.type != "null"}
    if len(types) <= 1:
        col = F.lit(None)
        for c, v in reversed(pairs):
            col = F.when(c, v.col if v.type != "null" else F.lit(None)).otherwise(col)
        return Value(col, types.pop() if types else "null", err)
    pairs.append((F.lit(True), Value(F.lit(None), "null")))
    return Value(_picked(pairs, lambda v: v.col.cast("variant") if v.type != "null" else F.lit(None).cast("variant")), "any", err, tuple(pairs))


def _picked(pairs, of):
    """``of`` the first value whose condition holds."""
    out = None
    for c, v in reversed(pairs):
        out = F.when(c, of(v)) if out is None else F.when(c, of(v)).otherwise(out)
    return out


def each(v: Value, kind: str, f) -> Value:
    """``f`` of a value of several types, to one type: of whichever it has."""
    cast = {"int": "long", "float": "double", "str": "string", "bool": "boolean"}[kind]
    found = [(c, f(x)) for c, x in v.choices]
    err = any(x.err is not False for _, x in found) and _picked(found, lambda x: F.lit(x.err) if isinstance(x.err, bool) else x.err)
    return Value(_picked(found, lambda x: x.col.cast(cast)), kind, either(v.err, err))


def either(*errs):
    """True where any of the flags is."""
    if any(e is True for e in errs):
        return True
    live = [e for e in errs if e is not False]
    if not live:
        return False
    out = live[0]
    for e in live[1:]:
        out = out | e
    return out


def when_ok(v: Value) -> Column:
    """The value, null where it failed."""
    if v.err is True:
        return F.lit(None).cast({"int": "long", "float": "double", "str": "string", "bool": "boolean", "null": "void", "any": "variant"}[v.type])
    return v.col if v.err is False else F.when(~v.err, v.col)


def truthy(v: Value) -> Column:
    """Whether a value counts as true; null doesn't, NaN does."""
    if v.type == "any":
        return F.coalesce(_picked(v.choices, truthy), F.lit(False))
    if v.type == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.type in ("int", "float"):
        return F.coalesce(v.col != 0, F.lit(False))
    if v.type == "str":
        return F.coalesce(v.col != "", F.lit(False))
    return F.lit(False)


def number(v: Value) -> Value:
    """A function's numeric argument: numbers as they are, strings parsed; null or other text fails."""
    if v.type in ("int", "float"):
        return Value(v.col, v.type, either(v.err, v.col.isNull()))
    if v.type == "any":
        return each(v, "float", number)
    if v.type == "str":
        parsed = F.trim(v.col).try_cast("double")
        return Value(parsed, "float", either(v.err, parsed.isNull()))
    return Value(F.lit(None).cast("double"), "float", True)


def double(v: Value) -> Value:
    n = number(v)
    return Value(n.col.cast("double"), "float", n.err)


def text(v: Value) -> Value:
    """A function's string argument; anything else fails."""
    if v.type == "any":
        return each(v, "str", text)
    if v.type == "str":
        return Value(v.col, "str", either(v.err, v.col.isNull()))
    return Value(F.lit(None).cast("string"), "str", True)


def whole(v: Value) -> Value:
    """A function's integer argument; floats are cut off."""
    n = number(v)
    return n if n.type == "int" else Value(saturated(n.col), "int", n.err)


def saturated(x: Column) -> Column:
    """A double as a long: cut off, clamped to the long's range, NaN as 0."""
    cut = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return F.when(F.isnan(x), F.lit(0).cast("long")).when(x >= 9.223372036854775e18, F.lit(2**63 - 1)).when(x <= -9.223372036854775e18, F.lit(-(2**63))).otherwise(cut.cast("long"))


def shown(v: Value) -> Column:
    """A value as text inside concat: null is empty, a whole float has no point, no exponents."""
    if v.type == "any":
        return F.coalesce(_picked(v.choices, shown), F.lit(""))
    if v.type == "float":
        return F.coalesce(_decimal(v.col), F.lit(""))
    return F.coalesce(v.col.cast("string"), F.lit(""))


def _decimal(x: Column) -> Column:
    """The shortest digits that tell a double, with all its places written out."""
    raw = x.cast("string")
    plain = F.regexp_replace(raw, r"\.0$", "")
    sign = F.when(F.startswith(raw, F.lit("-")), "-").otherwise("")
    part = lambda n: F.regexp_extract(raw, r"^-?([0-9])\.([0-9]+?)0*E(-?[0-9]+)$", n)
    first, rest, power = part(1), F.regexp_replace(part(2), "^0$", ""), part(3).try_cast("int")
    digits = F.concat(first, rest)
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    big = F.when(power >= F.char_length(rest), F.concat(digits, zeros(power - F.char_length(rest)))).otherwise(
        F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2)))
    small = F.concat(F.lit("0."), zeros(-power - 1), digits)
    written = F.concat(sign, F.when(power >= 0, big).otherwise(small))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(power.isNotNull(), written).otherwise(plain)
