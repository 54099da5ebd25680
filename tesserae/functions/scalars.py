"""The scalar functions; ill-typed input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError
from .values import LOWER, UPPER, Value, as_double, as_text, instant, lit

#: Least and most arguments.
ARITY = {
    "ABS": (1, 1), "CEIL": (1, 1), "CONCAT": (1, 99), "CURDATE": (0, 0), "DATE": (1, 1), "DATEDIFF": (2, 2), "DAY": (1, 1),
    "FLOOR": (1, 1), "HOUR": (1, 1), "IFNULL": (2, 2), "LENGTH": (1, 1), "LOWER": (1, 1), "MONTH": (1, 1), "NOW": (0, 0),
    "REPLACE": (3, 3), "ROUND": (1, 2), "SUBSTR": (2, 3), "TRIM": (1, 1), "UPPER": (1, 1), "YEAR": (1, 1),
}
ALIASES = {"AÑO": "YEAR"}
BLANK = " \t\n\r\0\x0b"


def canonical(name: str, n_args: int) -> str:
    name = ALIASES.get(name.upper(), name.upper())
    if name not in ARITY:
        raise EngineError(f"unknown function {name}")
    least, most = ARITY[name]
    if not least <= n_args <= most:
        raise EngineError(f"{name} takes {least} to {most} arguments; it got {n_args}")
    return name


def _text(v: Value) -> Column:
    return as_text(v)


def _on_time(f):
    def run(v: Value) -> Value:
        return Value(f(instant(v)).cast("long"), "int") if v.kind in ("text", "time") else lit(None)

    return run


def _on_number(f, kind: str | None = None):
    def run(v: Value) -> Value:
        return Value(f(v), kind or v.kind) if v.number else lit(None)

    return run


def _substr(s: Value, start: Value, length: Value | None = None) -> Value:
    """By bytes, from 0; a negative start counts from the end, a negative length stops before it."""
    if not start.number or (length is not None and not length.number):
        return lit(None)
    raw = F.encode(_text(s), "UTF-8")
    n = F.octet_length(_text(s))
    i = start.col.cast("int")
    begin = F.when(i >= 0, F.least(i, n)).otherwise(F.greatest(n + i, F.lit(0)))
    if length is None:
        end = n
    else:
        k = length.col.cast("int")
        end = F.when(k >= 0, F.least(begin + k, n)).otherwise(F.greatest(n + k, begin))
    return Value(F.substring(raw, begin + 1, F.greatest(end - begin, F.lit(0))).cast("string"), "text")


def _length(v: Value) -> Value:
    if v.kind in ("list", "map"):
        return Value(F.when(v.col.isNotNull(), F.size(v.col)).cast("long"), "int") if v.kind == "list" else lit(None)
    return Value(F.octet_length(_text(v)).cast("long"), "int")


def _ifnull(a: Value, b: Value) -> Value:
    if a.kind == "null":
        return b
    if b.kind == "null":
        return a
    if a.kind == b.kind:
        return Value(F.coalesce(a.col, b.col), a.kind, a.literal if a.kind == "list" else None)
    if a.number and b.number:
        return Value(F.coalesce(as_double(a), as_double(b)), "float")
    return Value(F.coalesce(_text(a), _text(b)), "text")


def _date(v: Value) -> Value:
    return Value(F.date_format(instant(v), "yyyy-MM-dd"), "text") if v.kind in ("text", "time") else lit(None)


def _datediff(a: Value, b: Value) -> Value:
    if not {a.kind, b.kind} <= {"text", "time"}:
        return lit(None)
    seconds = [F.unix_timestamp(instant(v).cast("timestamp")) for v in (b, a)]
    return Value(F.try_divide(seconds[0] - seconds[1], F.lit(86400)).cast("long"), "int")


def call(name: str, args: list[Value]) -> Value:
    match canonical(name, len(args)):
        case "UPPER":
            return Value(F.translate(_text(args[0]), LOWER, UPPER), "text")
        case "LOWER":
            return Value(F.translate(_text(args[0]), UPPER, LOWER), "text")
        case "TRIM":
            return Value(F.btrim(_text(args[0]), F.lit(BLANK)), "text")
        case "LENGTH":
            return _length(args[0])
        case "CONCAT":
            return Value(F.concat_ws("", *[as_text(v, ("true", "false")) for v in args]), "text")
        case "SUBSTR":
            return _substr(*args)
        case "REPLACE":
            s, a, b = map(_text, args)
            return Value(F.when(a == "", s).otherwise(F.replace(s, a, b)), "text")
        case "ROUND":
            places = args[1].literal if len(args) > 1 and args[1].kind == "int" else 0
            return _on_number(lambda v: F.round(as_double(v), int(places)), "float")(args[0])
        case "ABS":
            return _on_number(lambda v: F.abs(v.col))(args[0])
        case "CEIL":
            return _on_number(lambda v: F.ceil(as_double(v)).cast("double"), "float")(args[0])
        case "FLOOR":
            return _on_number(lambda v: F.floor(as_double(v)).cast("double"), "float")(args[0])
        case "NOW":
            return Value(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx"), "text")
        case "CURDATE":
            return Value(F.date_format(F.current_date(), "yyyy-MM-dd"), "text")
        case "DATE":
            return _date(args[0])
        case "YEAR":
            return _on_time(F.year)(args[0])
        case "MONTH":
            return _on_time(F.month)(args[0])
        case "DAY":
            return _on_time(F.dayofmonth)(args[0])
        case "HOUR":
            return _on_time(F.hour)(args[0])
        case "DATEDIFF":
            return _datediff(*args)
        case "IFNULL":
            return _ifnull(*args)
    raise EngineError(f"unknown function {name}")
