"""Similarity queries of the language: pre-filter, nearest, threshold, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.values import Value
from ..operators import similarity
from .lower import Scope
from .syntax import Both, Compare, Lit, Name, Select, names, signature

SCORE_NAME, SCORE_COLUMN = "parecido", "_score"
DEFAULT_K = 10


def split(where) -> tuple[object, Compare | None]:
    """A WHERE as (what comes before the search, the score's threshold)."""
    parts = list(where.parts) if isinstance(where, Both) else [where] if where is not None else []
    limits = [p for p in parts if isinstance(p, Compare) and p.left == Name(SCORE_NAME) and isinstance(p.right, Lit)]
    rest = [p for p in parts if p not in limits]
    if len(limits) > 1:
        raise EngineError(f"{SCORE_NAME} may be compared once")
    if any(SCORE_NAME in names(p) for p in rest):
        raise EngineError(f"{SCORE_NAME} is compared at the top level, joined by AND")
    before = None if not rest else rest[0] if len(rest) == 1 else Both(tuple(rest))
    return before, limits[0] if limits else None


def passes(limit: Compare) -> Column:
    score, bound = F.col("score"), float(limit.right.value)
    found = {">": score > bound, ">=": score >= bound, "<": score < bound, "<=": score <= bound, "=": F.abs(score - bound) <= 1e-6}
    if limit.op not in found:
        raise EngineError(f"{SCORE_NAME} {limit.op} is not known")
    return found[limit.op]


def select(engine, s: Select) -> DataFrame:
    before, limit = split(s.where)
    where = engine.find(s.collection)
    where = where.where_expr(before) if before is not None else None
    found = engine.similar(s.collection, s.near, s.limit if s.limit is not None else DEFAULT_K, where)
    if limit is not None:
        found = found.where(passes(limit))
    scope = Scope(found.drop("score"))
    score = Value(found["score"], "float")
    out: dict[str, Value] = {}
    star = any(v is None for v, _ in s.items)
    if not star:
        out[SCORE_COLUMN] = score
    for v, alias in s.items:
        if v is None:
            out |= {c: scope.name(c) for c in scope.df.columns}
        else:
            out[alias or signature(v)] = scope.value(v)
    if star:
        out[SCORE_COLUMN] = score
    return found.select(*[v.col.alias(n) for n, v in out.items()])


def hybrid(df: DataFrame, near: DataFrame, holds: Column, key: str, k: int) -> DataFrame:
    """Fused ranks of a similarity list (2 k rows) and of the documents that hold a text, in key order.

    Of the second list only its first k can enter by themselves; the exact
    ranks of the similarity list's documents in it are counted in one pass. No
    list is numbered in one task.
    """
    held = df.where(holds).select(key)
    listed = near.select(key, "rank").collect()
    c, counts = F.col(key), []
    for i, r in enumerate(listed):
        counts += [F.count_if(c < F.lit(r[key])).alias(f"n{i}"), F.coalesce(F.bool_or(c == F.lit(r[key])), F.lit(False)).alias(f"b{i}")]
    found = held.agg(*counts).first() if counts else {}
    session = df.sparkSession
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, rank long"
    ranks = session.createDataFrame([(r[key], found[f"n{i}"] + 1) for i, r in enumerate(listed) if found[f"b{i}"]], schema)
    words = similarity.ranked(held, c, most=k).select(key, F.col("rank").cast("long")).union(ranks).distinct()
    near = session.createDataFrame([(r[key], r["rank"]) for r in listed], schema)
    out = similarity.fused({"significado": near, "palabra": words}, key, k)
    return out.join(df, key).orderBy(F.desc("puntos"), key)
