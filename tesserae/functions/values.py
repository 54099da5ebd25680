"""Values and two-valued predicates.

Every predicate is a boolean that is never null, so NOT is plain negation.
Comparisons are directed by static types: no coercion outside number against
numeric text, nothing equals a null but a null, and a null is below all else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError

#: What counts as a number in a text, for equality and for order.
EQUAL_NUMBER = r"^-?\d+(\.\d+)?$"
ORDER_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str  # null, bool, int, float, text, time, list, map
    literal: object = None  # a constant's value; a list's kind of element
    constant: bool = False

    @property
    def number(self) -> bool:
        return self.kind in ("int", "float")


def kind_of(t: T.DataType) -> str:
    match t:
        case T.BooleanType():
            return "bool"
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return "int"
        case T.FloatType() | T.DoubleType() | T.DecimalType():
            return "float"
        case T.StringType():
            return "text"
        case T.DateType() | T.TimestampType() | T.TimestampNTZType():
            return "time"
        case T.ArrayType():
            return "list"
        case T.NullType():
            return "null"
    return "map"


def lit(v: object) -> Value:
    if v is None:
        return Value(F.lit(None).cast("string"), "null", None, True)
    kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "text"
    if kind == "int" and not -(1 << 63) <= v < 1 << 63:
        v, kind = float(v), "float"
    return Value(F.lit(v), kind, v, True)


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def as_double(v: Value) -> Column:
    return v.col.cast("double")


def instant(v: Value) -> Column:
    """A timestamp without zone; texts that are none give null."""
    if v.kind == "time":
        return v.col.cast("timestamp_ntz")
    return F.try_to_timestamp(v.col).cast("timestamp_ntz")


def as_text(v: Value, booleans: tuple[str, str] = ("1", "")) -> Column:
    """The text of a scalar: whole floats print without a fraction; lists have none."""
    match v.kind:
        case "text":
            return v.col
        case "int":
            return v.col.cast("string")
        case "float":
            d = as_double(v)
            whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
            return F.when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))
        case "bool":
            return F.when(v.col, booleans[0]).when(~v.col, booleans[1])
        case "time":
            return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss")
    return F.lit(None).cast("string")


def numeric_text(v: Value, pattern: str) -> Column:
    return F.when(v.col.rlike(pattern), F.expr("1") * F.trim(v.col).try_cast("double"))


def equal(a: Value, b: Value) -> Column:
    if a.kind == "null" or b.kind == "null":
        return a.col.isNull() & b.col.isNull() if not (a.kind == b.kind == "null") else F.lit(True)
    if a.number and b.number:
        if a.kind == b.kind == "int":
            return a.col.eqNullSafe(b.col)
        return as_double(a).eqNullSafe(as_double(b))
    if a.kind == b.kind and a.kind != "map":
        return a.col.eqNullSafe(b.col)
    if "time" in (a.kind, b.kind) and "text" in (a.kind, b.kind):
        return yes(instant(a) == instant(b)) | (a.col.isNull() & b.col.isNull())
    if a.number and b.kind == "text":
        a, b = b, a
    if a.kind == "text" and b.number:
        return yes(numeric_text(a, EQUAL_NUMBER) == as_double(b)) | (a.col.isNull() & b.col.isNull())
    return a.col.isNull() & b.col.isNull()


def _ordered(a: Value, b: Value):
    """Pairs (condition, left, right) to compare by, the first whose condition holds; None: no order."""
    if a.number and b.number:
        return [(None, a.col if a.kind == b.kind else as_double(a), b.col if a.kind == b.kind else as_double(b))]
    if "time" in (a.kind, b.kind) and {a.kind, b.kind} <= {"time", "text"}:
        return [(None, instant(a), instant(b))]
    if a.kind in ("list", "map") or b.kind in ("list", "map"):
        return None
    if a.kind == b.kind == "text":
        # a constant that is no number settles it: no numeric view is needed
        for v in (a, b):
            if v.constant and not re.match(ORDER_NUMBER, v.literal):
                return [(None, a.col, b.col)]
    na = as_double(a) if a.number else numeric_text(a, ORDER_NUMBER) if a.kind == "text" else None
    nb = as_double(b) if b.number else numeric_text(b, ORDER_NUMBER) if b.kind == "text" else None
    text = (None, as_text(a), as_text(b))
    return [text] if na is None or nb is None else [(na.isNotNull() & nb.isNotNull(), na, nb), text]


def _compare(a: Value, b: Value, how) -> Column:
    found = _ordered(a, b)
    if found is None:
        rank = {"list": 1, "map": 1}
        x, y = rank.get(a.kind, 0), rank.get(b.kind, 0)
        return F.when(a.col.isNotNull() & b.col.isNotNull(), how(F.lit(x), F.lit(y)))
    out = None
    for cond, x, y in reversed(found):
        out = how(x, y) if cond is None else F.when(cond, how(x, y)).otherwise(out)
    return out


def less(a: Value, b: Value, or_equal: bool = False, loose: bool = False) -> Column:
    """a < b or a <= b, null lowest. loose: may be null for false, which a filter treats alike and a scan can push."""
    sure = (lambda c: c) if loose else yes
    missing = lambda v: F.lit(v.kind == "null") if v.constant else v.col.isNull()
    if a.kind == "null":
        return F.lit(True) if or_equal else ~missing(b)
    if b.kind == "null":
        return missing(a) if or_equal else F.lit(False)
    how = (lambda x, y: x <= y) if or_equal else (lambda x, y: x < y)
    found = sure(_compare(a, b, how))
    if a.constant:
        return found
    return missing(a) | found if or_equal or b.constant else (missing(a) & ~missing(b)) | found


def compare(op: str, a: Value, b: Value, loose: bool = False) -> Column:
    match op:
        case "=":
            return equal(a, b)
        case "!=":
            return ~equal(a, b)
        case "<":
            return less(a, b, False, loose)
        case "<=":
            return less(a, b, True, loose)
        case ">":
            return less(b, a, False, loose)
        case ">=":
            return less(b, a, True, loose)
    raise EngineError(f"unknown operator {op}")


def among(a: Value, items: list[Value], loose: bool = False) -> Column:
    if not items:
        return F.lit(False)
    alike = lambda v: v.kind == a.kind and v.constant and a.kind in ("int", "text", "bool")
    plain = [v.literal for v in items if alike(v)]
    tests = [a.col.isin(plain) if loose else yes(a.col.isin(plain))] if plain else []
    tests += [equal(a, v) for v in items if not alike(v)]
    return reduce(lambda x, y: x | y, tests)


def like(a: Value, pattern: object) -> Column:
    """Case-insensitive; % and _ only; one character is never a line break."""
    if a.kind != "text" or not isinstance(pattern, str):
        return F.lit(False)
    return yes(a.col.rlike(like_regex(pattern)))


def like_regex(pattern: str) -> str:
    """A pattern that never backtracks over a piece found before: the first place of each inner piece will do."""

    def piece(s: str) -> str:
        return "".join("." if c == "_" else re.escape(c) if not c.isspace() else c for c in s)

    first, *rest = map(piece, re.split("%+", pattern))
    if not rest:
        return rf"(?iu)^{first}\z"
    *inner, last = rest
    found = "".join(f"(?>.*?{p})" for p in inner) if "\n" not in pattern else "".join(f".*{p}" for p in inner)
    return rf"(?iu)^{first}{found}.*{last}\z"


def contains(a: Value, b: Value) -> Column:
    if a.kind == "list":
        return yes(F.exists(a.col, lambda x: equal(Value(x, a.literal or b.kind), b)))
    if a.kind != "text" or not (b.kind == "text" or b.number):
        return F.lit(False)
    hay, needle = F.translate(a.col, UPPER, LOWER), F.translate(as_text(b), UPPER, LOWER)
    return yes(F.contains(hay, needle))


def between(a: Value, low: Value, high: Value, loose: bool = False) -> Column:
    if a.kind == "null":
        return F.lit(False)
    return a.col.isNotNull() & less(low, a, True, loose) & less(a, high, True, loose)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Numbers only, save that + joins two texts; anything else is null."""
    if op == "+" and a.kind == b.kind == "text":
        return Value(F.concat(a.col, b.col), "text")
    if not (a.number and b.number):
        return lit(None)
    whole = a.kind == b.kind == "int"
    x, y = (a.col.cast("long"), b.col.cast("long")) if whole else (as_double(a), as_double(b))
    kind = "int" if whole else "float"
    match op:
        case "+":
            return Value(F.try_add(x, y), kind)
        case "-":
            return Value(F.try_subtract(x, y), kind)
        case "*":
            return Value(F.try_multiply(x, y), kind)
        case "/":
            return Value(F.try_divide(as_double(a), as_double(b)), "float")
        case "%":
            return Value(F.try_mod(as_double(a), as_double(b)), "float")
    raise EngineError(f"unknown operator {op}")
