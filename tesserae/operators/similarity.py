"""Two-stage similarity search and reciprocal-rank fusion, as plans.

Sign bits of the normalised vectors are kept in 63-bit words. A query's words
are compared by bit counts (the sieve), the nearest candidates are scored by
the exact cosine, and the k-th best score is a floor: whatever else can reach
it by its signs is scored as well, so the sieve loses no answer. Take-ordered
steps, no shuffle of the table. Vectors stay on the JVM; only free text is
embedded in Python.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.embed import Embedder

WORD = 63
#: Candidates of each precision mode, by k, that set the floor; exact mode takes all.
MODES = {"rapida": (200, 20), "equilibrada": (2000, 200), "exacta": None}
RANK_BASE = 60
#: Places that scores are rounded to unless a query names others.
PLACES = 6
#: Rows and bytes of one Arrow batch of texts: bounds a Python worker's memory.
BATCH_ROWS = 1024
BATCH_BYTES = 4 << 20


def once(value: Column, use) -> Column:
    """use(value), with value computed once a row: what a lambda takes from outside is computed anew for each element."""
    return F.transform(F.array(value), use)[0]


def normalised(vec: Column) -> Column:
    """Length one, as stored: 32-bit floats; a zero vector stays."""

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return once(norm, lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))

    return once(F.transform(vec, lambda x: x.cast("double")), scaled)


def bits_of(v: np.ndarray) -> list[int]:
    """A query's sign words."""
    on = np.asarray(v) > 0
    return [sum(1 << i for i, b in enumerate(on[k : k + WORD].tolist()) if b) for k in range(0, len(on), WORD)]


def code_of(vec: Column, dims: int) -> list[Column]:
    """Sign words of a vector column."""
    return [
        F.aggregate(F.slice(vec, k + 1, min(WORD, dims - k)), F.struct(F.lit(0).cast("long").alias("w"), F.lit(1).cast("long").alias("b")),
                    lambda a, x: F.struct((a["w"] + F.when(x > 0, a["b"]).otherwise(F.lit(0))).alias("w"), F.shiftleft(a["b"], 1).alias("b")))["w"]
        for k in range(0, dims, WORD)
    ]


def hamming(vec: Column, query: np.ndarray) -> Column:
    """Differing sign bits between a vector column and a query."""
    words = code_of(vec, len(query))
    return reduce(lambda a, b: a + b, [F.bit_count(w.bitwiseXOR(F.lit(q).cast("long"))) for w, q in zip(words, bits_of(query), strict=True)])


def reach(vec: Column, query: np.ndarray) -> Column:
    """The most that a vector of these signs can score: the length of the query's part of equal signs; NaN or null where a component is no finite number."""
    squares = F.array(*[F.lit(float(x * abs(x))) for x in query])
    terms = F.zip_with(vec, squares, lambda a, b: F.when((a > 0) == (b > 0), F.abs(b)).otherwise(F.lit(0.0)) + a.cast("double") * 0)
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def cosine(vec: Column, query: np.ndarray, places: int = PLACES) -> Column:
    """Dot product of a normalised column and a normalised query, rounded."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.round(F.aggregate(F.zip_with(vec, q, lambda a, b: a.cast("float").cast("double") * b), F.lit(0.0), lambda a, x: a + x), places)


def unit(query) -> np.ndarray:
    q = np.asarray(query, float)
    if not np.isfinite(q).all():
        raise EngineError("a vector holds finite numbers only")
    n = np.sqrt((q * q).sum())
    return (q / n if n > 0 else q).astype(np.float32).astype(float)


def embedded(df: DataFrame, text: Column, embedder: Embedder, name: str) -> DataFrame:
    """df with an embedded text column, by Arrow batches of at most BATCH_ROWS texts; a filter of the vectors embeds no text again."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{key}").lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))

    def run(texts: pa.Array) -> pa.Array:
        vectors = [np.asarray(embedder.vector(t.as_py()), float) if t.is_valid else None for t in texts]
        ends = np.cumsum([0] + [0 if v is None else len(v) for v in vectors], dtype=np.int32)
        there = [v for v in vectors if v is not None]
        values = pa.array(np.concatenate(there) if there else np.empty(0))
        return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([v is None for v in vectors], pa.bool_()))

    return df.withColumn(name, F.arrow_udf(run, "array<double>").asNondeterministic()(text))


def candidates(mode: str, k: int) -> int | None:
    if mode not in MODES:
        raise EngineError(f"unknown precision {mode}; there are {', '.join(MODES)}")
    found = MODES[mode]
    return None if found is None else max(found[0], found[1] * k)


def nearest(df: DataFrame, vec: str, key: str, query, k: int = 10, mode: str = "rapida", places: int = PLACES) -> DataFrame:
    """The k rows of df nearest to the query, with score; ties of the rounded score go by the key."""
    q = unit(query)
    if len(q) % 8:
        raise EngineError("a vector's length is a multiple of 8")

    def best(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn(vec, normalised(F.col(vec)))
        return rows.withColumn("score", cosine(F.col(vec), q, places)).orderBy(F.desc("score"), key).limit(k)

    rows = df.where(F.size(vec) == len(q))
    most = candidates(mode, k)
    if most is not None:
        # signs do not depend on the length: only what passes them is normalised
        sieved = rows.withColumn("__ham", hamming(F.col(vec), q)).orderBy("__ham", key).limit(most).drop("__ham")
        floor = best(sieved).agg(F.when(F.count("score") == k, F.min("score"))).scalar()
        rows = rows.where(F.coalesce(reach(F.col(vec), q) >= floor - 10.0**-places, F.lit(True)))
    return best(rows)


def fused(lists: dict[str, DataFrame], key: str, k: int) -> DataFrame:
    """Reciprocal-rank fusion of lists with a 1-based rank: key, puntos and en (the lists that hold it)."""
    parts = [df.select(F.col(key), F.lit(name).alias("list"), F.lit(i).alias("at"), (1 / (RANK_BASE + F.col("rank"))).alias("part")) for i, (name, df) in enumerate(lists.items())]
    both = reduce(lambda a, b: a.union(b), parts)
    out = both.groupBy(key).agg(F.sum("part").alias("sum"), F.sort_array(F.collect_list(F.struct("at", "list"))).alias("from"))
    out = out.select(key, F.round("sum", 8).alias("puntos"), F.transform("from", lambda x: x["list"]).alias("en"))
    return out.orderBy(F.desc("puntos"), key).limit(k)


def ranked(df: DataFrame, *order: Column, most: int) -> DataFrame:
    """The first rows in order with their 1-based rank; most bounds the rows that are numbered in one place."""
    return df.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
