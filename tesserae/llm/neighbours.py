"""Approximate nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and residual codebooks are fitted on a sample of at most
SAMPLE distinct vectors (those of smallest hash); every row is indexed. The
number of lists a query probes is the least that finds PROBE_RECALL of the
sample's own neighbours. Rows and queries meet in cells of a list: lists and
query sets of any size are cut into chunks of at most CHUNK, so no cell grows
with the data. In a cell, asymmetric distance tables score the codes, the best
SHORT of each query are scored again on the original vectors in double
precision, and those that reach the query's floor go on; the floor is well
below the k-th best score among the sample's vectors. Where a code left out
could still reach the answers (its score plus the length of the query times
what quantisation lost of the vector), the query is scored against the whole
cell, so a cell gives its exact answers whatever the codes. A query that is left
with fewer than k answers though there are more candidates is searched again
over all lists without a floor.

Equal vectors are searched once: an entry stands for all its rows by the k + 1
smallest ids, which hold every id that can be an answer.

Defined results: vectors that are null, zero, of another length than ``dims``
or hold null or non-finite components take no part, nor do rows with a null
id. Ties go to the smaller id. Rows that repeat a query's id count as its own.
Fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, table

#: Most vectors that centroids and codebooks are fitted on, and that floors are taken from.
SAMPLE = 16_384
#: Parts of a vector that are quantised separately, and codewords of a part.
PARTS, WORDS = 16, 256
#: Part of the sample's neighbours that the probed lists must hold.
PROBE_RECALL = 0.985
#: Codes of a cell that are scored exactly for a query before it is known whether that is enough.
SHORT = 64
#: Rounding of single precision scores, as a part of the product of both lengths.
ROUNDING = 1e-5
#: A floor lies at the score of the SPARE * k-th of the sample, so that lists not probed leave enough answers.
SPARE = 4
#: Vectors and queries of a cell.
CHUNK = 4096
#: Salts by which a vector's ids are ranked before they meet.
SALTS = 32
SEED = 7


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The closest centre of each row, in blocks."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, 1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(steps):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, own, x)
        held = n > 0
        centres[held] = (sums[held] / n[held, None]).astype(np.float32)
    return centres


class Index:
    """Centroids, codebooks and the number of probes; small whatever the table's size."""

    def __init__(self, sample: np.ndarray, n_rows: int, k: int) -> None:
        rng = np.random.default_rng(SEED)
        self.sample = sample
        self.centres = kmeans(sample, int(np.clip(round(n_rows**0.5), 1, 1024)), 12, rng)
        own = nearest(sample, self.centres)
        rest = sample - self.centres[own]
        dims = sample.shape[1]
        parts = next(p for p in (PARTS, 8, 4, 2, 1) if dims % p == 0)
        self.books = [kmeans(part, WORDS, 8, rng) for part in np.split(rest, parts, axis=1)]
        self.probes = self._probes(own, k)

    def _probes(self, own: np.ndarray, k: int) -> int:
        asked = np.linspace(0, len(self.sample) - 1, min(512, len(self.sample))).astype(int)
        scores = self.sample[asked] @ self.sample.T
        scores[np.arange(len(asked)), asked] = -np.inf
        k = min(k, len(self.sample) - 1)
        if k < 1:
            return 1
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = np.argsort(-(self.sample[asked] @ self.centres.T), axis=1)
        place = np.argsort(order, axis=1)
        needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(PROBE_RECALL * len(needed))))]) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centres)
        rest = np.split(x - self.centres[own], len(self.books), axis=1)
        return own, np.stack([nearest(p, b) for p, b in zip(rest, self.books, strict=True)], 1).astype(np.uint8)

    def lost(self, part: int, codes: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The distance of each vector of a list from what its code stands for."""
        held = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return np.linalg.norm((x - self.centres[part] - held).astype(np.float64), axis=1)

    def lists_of(self, q: np.ndarray, every: bool = False) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, : None if every else self.probes]

    def floors(self, q: np.ndarray, k: int) -> np.ndarray:
        """The SPARE * k-th best score among the sample's vectors; -inf where the sample has no more."""
        at = len(self.sample) - SPARE * k
        if at <= 0:
            return np.full(len(q), -np.inf)
        return np.partition(q.astype(np.float64) @ self.sample.T.astype(np.float64), at, axis=1)[:, at] - 1e-6


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def search_cell(index: Index, part: int, codes: np.ndarray, x: np.ndarray, ids: np.ndarray, q: np.ndarray, floors: np.ndarray, keep: int):
    """(query, row, score) of the cell's answers that reach the floors, the best ``keep`` of each query."""
    found = []
    tables = [b @ q_part.T for b, q_part in zip(index.books, np.split(q, len(index.books), axis=1), strict=True)]
    base = q @ index.centres[part]
    size = np.linalg.norm(x.astype(np.float64), axis=1).max(initial=0)
    slack = (index.lost(part, codes, x) + ROUNDING * (size + np.linalg.norm(index.centres[part]))).astype(np.float32)
    x, q = x.astype(np.float64), q.astype(np.float64)
    length = np.linalg.norm(q, axis=1)
    for i in range(0, len(q), 256):
        approx = np.repeat(base[None, i : i + 256], len(x), 0)
        for m, t in enumerate(tables):
            approx += t[codes[:, m], i : i + 256]
        n = approx.shape[1]
        short = min(SHORT, len(x))
        rows = np.argpartition(-approx, short - 1, axis=0)[:short]
        score = np.einsum("ijk,jk->ij", x[rows], q[i : i + n])
        least = floors[i : i + n]
        if short >= keep:
            least = np.maximum(least, np.partition(score, short - keep, axis=0)[short - keep])
        approx += slack[:, None] * length[i : i + n].astype(np.float32)
        np.put_along_axis(approx, rows, -np.inf, axis=0)
        wide = approx.max(0) >= least
        own, rows, score = np.repeat(np.arange(i, i + n)[~wide], short), rows[:, ~wide].T.ravel(), score[:, ~wide].T.ravel()
        if wide.any():
            every = x @ q[i : i + n][wide].T
            at, of = np.nonzero(every >= least[wide] - ROUNDING * size * length[i : i + n][wide])
            own, rows, score = np.append(own, i + np.flatnonzero(wide)[of]), np.append(rows, at), np.append(score, every[at, of])
        ok = score >= floors[own]
        own, rows, score = own[ok], rows[ok], score[ok]
        order = np.lexsort((ids[rows], -score, own))
        own, rows, score = own[order], rows[order], score[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        ok = rank < keep
        found.append((own[ok], rows[ok], score[ok]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int | None = None) -> DataFrame:
    """vec_id and vec of the rows that take part; dims: the most common length (of equals the larger) where not given."""
    v = F.col(vec_col)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<float>").alias("vec")).where("vec_id is not null")
    finite = "forall(vec, x -> x is not null and not isnan(x) and abs(x) < float('infinity')) and exists(vec, x -> x <> 0)"
    rows = rows.where(F.col("vec").isNotNull() & (F.size("vec") > 0)).where(finite)
    if dims is None:
        common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        dims = common["n"] if common else 0
    return rows.where(F.size("vec") == dims)


def _chunks(df: DataFrame) -> dict[int, int]:
    """Chunks of each list: a number for each of at most 1024 lists."""
    return {r["part"]: -(-r["n"] // CHUNK) for r in df.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}


def _in_cells(df: DataFrame, own: str, by: dict, across: str, other: dict, key: str) -> DataFrame:
    """Each row in its own chunk of its list, once for every chunk of the other side."""

    def number(d: dict):
        found = F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv]) if d else F.create_map(F.lit(-1), F.lit(1))
        return F.coalesce(found[F.col("part")], F.lit(0))

    df = df.withColumn(own, F.pmod(F.xxhash64(key), F.greatest(number(by), F.lit(1))).cast("int"))
    return df.where(number(other) > 0).withColumn(across, F.explode(F.sequence(F.lit(0), number(other) - 1)))


def _found(indexed: DataFrame, of_rows: dict, ids: DataFrame, queries: DataFrame, shared, k: int, exhaustive: bool) -> DataFrame:
    """rep and found: each query vector's k + 1 best (r, vec_id, score)."""
    keep = k + 1

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                q = _vectors(part.column(1))
                lists, floors = index.lists_of(q, exhaustive), index.floors(q, k)
                if exhaustive:
                    floors = np.full(len(q), -np.inf)
                take = pa.array(np.repeat(np.arange(len(q)), lists.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), pa.array(lists.ravel().astype(np.int32)), pa.array(np.repeat(floors, lists.shape[1])), part.column(1).take(take)],
                    ["qrep", "part", "floor", "qvec"],
                )

    probes = materialize(map_batches(queries, probe, "qrep long, part int, floor double, qvec array<float>"), "probes")
    of_queries = _chunks(probes)
    left = _in_cells(indexed, "vchunk", of_rows, "qchunk", of_queries, "rep")
    right = _in_cells(probes, "qchunk", of_queries, "vchunk", of_rows, "qrep")
    key = ["part", "vchunk", "qchunk"]

    def cell(_, a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["qrep", "rep", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        x, q = _vectors(a["vec"]), _vectors(b["qvec"])
        codes = np.frombuffer(b"".join(a["code"].to_pylist()), np.uint8).reshape(len(x), -1)
        rep = a["rep"].to_numpy()
        own, rows, score = search_cell(shared.value, a["part"][0].as_py(), codes, x, rep, q, b["floor"].to_numpy(), keep)
        return pa.table([pa.array(b["qrep"].to_numpy()[own]), pa.array(rep[rows]), pa.array(score)], names)

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(cell, "qrep long, rep long, score double")
    best = Window.partitionBy("qrep").orderBy(F.desc("score"), "rep")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep).drop("r")
    named = found.join(ids, "rep").select("qrep", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("qrep").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep)
    return named.groupBy(F.col("qrep").alias("rep")).agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))


def search(rows: DataFrame, asked: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each asked id (a table of vec_id) among all rows."""
    keep = k + 1
    distinct = materialize(rows.groupBy("vec").agg(F.min("vec_id").alias("rep")), "distinct-vectors")
    members = materialize(rows.join(distinct, "vec").select("vec_id", "rep"), "vector-members")
    n = distinct.count()
    picked = distinct.select("vec", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep").limit(SAMPLE).select("vec").toArrow()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = Index(_vectors(picked.column("vec")), n, k)
    shared = rows.sparkSession.sparkContext.broadcast(index)  # SAMPLE vectors, centroids and codebooks: bounded

    salted = Window.partitionBy("rep", "salt").orderBy("vec_id")
    ranked = members.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("r", F.row_number().over(salted))
    ids = ranked.where(F.col("r") <= keep).groupBy("rep").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, keep).alias("ids"))

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, codes = shared.value.encode(_vectors(batch.column(0)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(0)], ["rep", "part", "code", "vec"]
            )

    indexed = materialize(map_batches(distinct.select("vec", "rep"), index_rows, "rep long, part int, code binary, vec array<float>"), "index")
    wanted = members.join(asked.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "rep").distinct()

    of_rows = _chunks(indexed)
    queries = distinct.join(wanted.select("rep").distinct(), "rep", "left_semi").select("rep", "vec")
    lists = materialize(_found(indexed, of_rows, ids, queries, shared, k, False), "answers")
    total = min(keep, members.count())
    short = lists.where(F.size("found") < total).select("rep").union(queries.join(lists, "rep", "left_anti").select("rep"))
    short = materialize(short, "short-answers")
    if short.head(1):
        again = _found(indexed, of_rows, ids, queries.join(short, "rep", "left_semi"), shared, k, True)
        lists = lists.join(short, "rep", "left_anti").union(again)
    answers = wanted.withColumnRenamed("vec_id", "query_id").join(lists, "rep")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = answers.select("query_id", F.posexplode(others).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op6_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    rows = valid_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(rows, rows.where("vec_id % 20 = 0").select("vec_id"), 20)
