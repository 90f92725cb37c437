"""The language's functions: arity, string arguments, and lowering to Catalyst.

The registry is closed; a name never reaches Spark's own functions, several of
which mean something else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from genoloom.functions import sequence
from genoloom.functions.values import Value, choice, double, each, either, number, saturated, shown, text, whole


@dataclass(frozen=True)
class Function:
    arity: tuple[int, int | None]
    strings: tuple[int, ...]
    lower: Callable[[list[Value]], Value]


def _abs(a):
    x = a[0]
    if x.type == "any":
        return each(x, "float", lambda v: _abs([v]))
    if x.type not in ("int", "float"):
        return Value(F.lit(None).cast("double"), "float", True)
    err = either(x.err, x.col.isNull())
    if x.type == "int":
        # the least long has no positive counterpart
        least = x.col == F.lit(-(2**63))
        return Value(F.when(~least, F.abs(x.col)), "int", either(err, least))
    return Value(F.abs(x.col), x.type, err)


def _to_int(f):
    def lower(a):
        x = number(a[0])
        return x if x.type == "int" else Value(saturated(f(x.col)), "int", x.err)

    return lower


def half_away(x):
    """Nearest whole number, halves away from zero, as a double; exact, as no sum is rounded."""
    size = F.abs(x)
    low = F.floor(size).cast("double")
    near = F.when(size - low >= 0.5, low + 1).otherwise(low)
    # from 2**52 on a double has no places
    return F.when((size >= 2.0**52) | F.isnan(x), x).when(x < 0, -near).otherwise(near)


def _round(a):
    x = number(a[0])
    if len(a) == 1:
        return x if x.type == "int" else Value(saturated(half_away(x.col)), "int", x.err)
    n = whole(a[1])
    scale = F.pow(F.lit(10.0), F.greatest(n.col, F.lit(0)).cast("double"))
    return Value(half_away(x.col.cast("double") * scale) / scale, "float", either(x.err, n.err))


def _ln(x):
    return F.when(F.isnan(x), x).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def _log(a):
    x = double(a[0])
    if len(a) == 1:
        return Value(_ln(x.col), "float", x.err)
    base = double(a[1])
    bottom = _ln(base.col)
    return Value(F.when(bottom == 0, ieee_divide(_ln(x.col), bottom)).otherwise(F.try_divide(_ln(x.col), bottom)), "float", either(x.err, base.err))


def ieee_divide(x, y):
    """x / y of doubles with infinities and NaN instead of errors."""
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def _extreme(pick, flip):
    def lower(a):
        xs = [number(x) for x in a]
        err = either(*(x.err for x in xs))
        if all(x.type == "int" for x in xs):
            return Value(xs[0].col if len(xs) == 1 else pick(*(x.col for x in xs)), "int", err)
        cols = [x.col.cast("double") for x in xs]
        # NaN is left out unless nothing else is there
        kept = [F.when(F.isnan(c), F.lit(flip)).otherwise(c) for c in cols]
        best = kept[0] if len(kept) == 1 else pick(*kept)
        all_nan = F.isnan(cols[0])
        for c in cols[1:]:
            all_nan = all_nan & F.isnan(c)
        return Value(F.when(all_nan, F.lit(float("nan"))).otherwise(best), "float", err)

    return lower


def _coalesce(a):
    """The first that isn't null, with its own type."""
    return choice([(x.col.isNotNull(), x) for x in a if x.type != "null"], either(*(x.err for x in a)))


def _texts(kind, f):
    def lower(a):
        xs = [text(x) for x in a]
        return Value(f(*(x.col for x in xs)), kind, either(*(x.err for x in xs)))

    return lower


def _concat(a):
    return Value(F.concat(*(shown(x) for x in a)) if a else F.lit(""), "str", either(*(x.err for x in a)))


def _substr(a):
    s, start = text(a[0]), whole(a[1])
    first = (F.least(F.greatest(start.col, F.lit(0)), F.lit(2**31 - 2)) + 1).cast("int")
    if len(a) == 2:
        return Value(F.substr(s.col, first), "str", either(s.err, start.err))
    n = whole(a[2])
    return Value(F.substr(s.col, first, F.least(F.greatest(n.col, F.lit(0)), F.lit(2**31 - 1)).cast("int")), "str", either(s.err, start.err, n.err))


def _translate(a):
    s = text(a[0])
    frame = whole(a[1]) if len(a) > 1 else Value(F.lit(0).cast("long"), "int")
    return Value(sequence.translated(s.col, F.greatest(frame.col, F.lit(0))), "str", either(s.err, frame.err))


def _codon_at(a):
    s, i = text(a[0]), whole(a[1])
    return Value(sequence.codon_at(s.col, i.col), "str", either(s.err, i.err))


def _double(f):
    def lower(a):
        xs = [double(x) for x in a]
        return Value(f(*(x.col for x in xs)), "float", either(*(x.err for x in xs)))

    return lower


FUNCTIONS: dict[str, Function] = {
    "abs": Function((1, 1), (), _abs),
    "floor": Function((1, 1), (), _to_int(F.floor)),
    "ceil": Function((1, 1), (), _to_int(F.ceil)),
    "sqrt": Function((1, 1), (), _double(F.sqrt)),
    "pow": Function((2, 2), (), _double(F.pow)),
    "round": Function((1, 2), (), _round),
    "log": Function((1, 2), (), _log),
    "min": Function((1, None), (), _extreme(F.least, float("inf"))),
    "max": Function((1, None), (), _extreme(F.greatest, float("-inf"))),
    "coalesce": Function((1, None), (), _coalesce),
    "len": Function((1, 1), (0,), _texts("int", lambda s: F.char_length(s).cast("long"))),
    "upper": Function((1, 1), (0,), _texts("str", F.upper)),
    "lower": Function((1, 1), (0,), _texts("str", F.lower)),
    "concat": Function((1, None), (), _concat),
    "contains": Function((2, 2), (0, 1), _texts("bool", F.contains)),
    "starts_with": Function((2, 2), (0, 1), _texts("bool", F.startswith)),
    "ends_with": Function((2, 2), (0, 1), _texts("bool", F.endswith)),
    "substr": Function((2, 3), (0,), _substr),
    "gc": Function((1, 1), (0,), _texts("float", sequence.gc)),
    "revcomp": Function((1, 1), (0,), _texts("str", sequence.revcomp)),
    "translate": Function((1, 2), (0,), _translate),
    "codon_at": Function((2, 2), (0,), _codon_at),
}
