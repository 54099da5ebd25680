"""Equi-joins with textual key equality and prefixed names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import Value, as_double, as_text, kind_of


def column(df: DataFrame, name: str) -> Value | None:
    """A column as a value, or nothing where df has no such column."""
    for f in df.schema.fields:
        if f.name == name:
            kind = kind_of(f.dataType)
            element = kind_of(f.dataType.elementType) if kind == "list" else None
            return Value(df[f"`{name}`"], kind, element)
    return None


def prefixed(df: DataFrame, alias: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(f"{alias}.{c}") for c in df.columns])


def keys(a: Value, b: Value):
    """What two keys are compared by: numbers as numbers, anything else as text; nulls and lists never match."""
    if a.kind == b.kind and a.kind in ("int", "text", "bool", "time"):
        return a.col, b.col
    if a.number and b.number:
        return as_double(a), as_double(b)
    return as_text(a, ("true", "false")), as_text(b, ("true", "false"))


def hash_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, outer: bool) -> DataFrame:
    """left's columns and right's; a key that one side lacks matches nothing."""
    a, b = column(left, left_key), column(right, right_key)
    how = "left" if outer else "inner"
    if a is None or b is None or a.kind in ("list", "map", "null") or b.kind in ("list", "map", "null"):
        return left.join(right, F.lit(False), how)
    x, y = keys(a, b)
    return left.join(right, x == y, how)
