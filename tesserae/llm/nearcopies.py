"""SimHash near copies, verified by the Jaccard similarity of their word shingles.

Texts with equal shingle sets meet first, by a 64-bit hash of the set, which
stands for all of them. Candidates come in buckets: the classes of SimHash
fingerprints that the trie self-join of ``simhash`` links, and, as sets at
SIMILAR mostly differ in more bits than a trie can walk, bands of minima. Sets
of similarity s agree in a band of ROWS minima
with chance s ** ROWS, so a pair at 0.8 shares none of the BANDS bands with
chance 4e-7, one above 0.8 with less. Each member of a
bucket is tried with the bucket's first one. The sets of buckets that still hold several
groups then meet by prefixes: in one order of all shingles, rare ones first,
two sets of similarity SIMILAR share a shingle among the first (1 - SIMILAR)
n + 1 of each, and the place of the first shared one bounds how many others
can follow. Shingles that no second set holds join nothing, so a large group
of texts that are just below SIMILAR to each other costs no visit of all its
pairs, nor does a group of near copies, which the first ones have linked
already. A pair is a link only if its whole sets reach SIMILAR, so groups are
the components of exactly verified links.

Defined results: words are as in ``simhash``; a text with fewer words than a
shingle has one shingle of them all, one without words has the empty set, and
empty sets are equal. Rows with a null doc_id take no part; rows that share a
doc_id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, join_skewed, map_batches, materialize, texts_of
from .components import components
from .linededup import FILTER_BITS
from .simhash import SEED, majority, shingle_hashes, signed
from .simhash import links as trie_links

#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 28, 4
#: Shingles whose minima are taken at a time.
BLOCK = 2048
#: Counters (two rows of them) that say which shingles are rare; their number is fixed, any order of the shingles gives the same links.
COUNTERS = 1 << 18
_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return _distinct(list(shingle_hashes(text, width)))


def _distinct(hashes: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)


def bands(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: equal keys mean ROWS equal minima; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), BLOCK):
        least = np.minimum(least, (shingles[None, i : i + BLOCK] * FACTORS[:, None] + SHIFTS[:, None]).min(1))
    return np.array([xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets' Jaccard similarity is at least SIMILAR; empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]


def _keyed(found: np.ndarray) -> tuple[int, np.ndarray]:
    """The shingle set behind a hash of itself."""
    return xxhash.xxh3_64_intdigest(found.tobytes()), found


def _keys(sets: list[tuple[int, np.ndarray]]) -> pa.Array:
    return pa.array(np.array([k for k, _ in sets], np.uint64).view(np.int64))


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, the key of the shingle set, its size, the text's fingerprint and the set's bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, fps = [], []
            for text in texts_of(batch.column(1)):
                hashes = list(shingle_hashes(text, width))
                fps.append(signed(majority(hashes)))
                sets.append(_keyed(_distinct(hashes)))
            sizes, found = pa.array([len(s) for _, s in sets], pa.int64()), pa.array([bands(s) for _, s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), _keys(sets), sizes, pa.array(fps, pa.int64()), found], ["doc_id", "id", "n", "fp", "bands"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, id long, n long, fp long, bands array<long>")


def _alike(sketches: DataFrame) -> DataFrame:
    """id, doc_id, n and key of each set by its fingerprints: equal keys mean one class of the trie self-join."""
    prints = materialize(sketches.groupBy("id", "fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "set-fingerprints")
    counted = materialize(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("times")), "distinct-fingerprints")
    classes = components(trie_links(counted.select("fp"))).withColumnRenamed("node", "fp")
    key = F.xxhash64(F.coalesce("component", "fp"), F.lit("simhash")).alias("key")
    named = materialize(counted.join(classes, "fp", "left").select("fp", key, "times"), "fingerprint-classes")
    return join_skewed(prints, named, ["fp"], "times").select("id", "doc_id", "n", "key")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id and shingles of the sets in wanted (id, doc_id); at most FILTER_BITS marks spare other documents the work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                sets = [_keyed(shingle_set(t, width)) for t in texts_of(batch.column(1).slice(i, 256))]
                yield pa.RecordBatch.from_arrays([_keys(sets), pa.array([s.tobytes() for _, s in sets], pa.binary())], ["id", "shingles"])

    mark = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    marks = F.broadcast(wanted.select(mark().alias("mark")).distinct())
    some = docs.select("doc_id", "text").withColumn("at", mark()).join(marks, F.col("at") == F.col("mark"), "left_semi")
    found = map_batches(some.select("doc_id", "text"), run, "id long, shingles binary")
    return found.join(wanted.select("id"), "id", "left_semi").groupBy("id").agg(F.first("shingles").alias("shingles"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar; a v may stand in very many pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            ok = pa.array([similar(x, y) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["u", "v"])

    times = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("times"))
    right = times.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    left = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
    met = join_skewed(left, materialize(right, "near-copy-firsts"), ["v"], "times")
    return map_batches(met.select("u", "v", "a", "b"), run, "u long, v long")


def _slots(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's counter in either row."""
    return (shingles % np.uint64(COUNTERS)).astype(np.int64), ((shingles >> np.uint64(32)) % np.uint64(COUNTERS)).astype(np.int64) + COUNTERS


def _counts(sets: DataFrame) -> np.ndarray:
    """For each counter how many sets hold one of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                for at in _slots(np.frombuffer(x, np.uint64)):
                    np.add.at(n, at, 1)
        at = np.flatnonzero(n)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)]), pa.array(n[at[i : i + (1 << 16)]])], ["at", "n"])

    rows = map_batches(sets.select("shingles"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # 2 * COUNTERS rows at most
    out = np.zeros(2 * COUNTERS, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    del rows
    give_back()
    return out


def prefix(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set's prefix that another set may hold, and their places in the order (count, shingle)."""
    n = len(shingles)
    a, b = _slots(shingles)
    of = np.minimum(counts[a], counts[b])  # at least the number of sets that hold it
    order = np.lexsort((shingles, of))[: n - -(-n * SIMILAR[0] // SIMILAR[1]) + 1]
    place = np.flatnonzero(of[order] > 1)
    return shingles[order[place]], place


def _prefixes(sets: DataFrame) -> DataFrame:
    """id, n, component, token and place of each prefix shingle; sets: id, n, component and shingles."""
    counts = sets.sparkSession.sparkContext.broadcast(_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix(np.frombuffer(x, np.uint64), counts.value) for x in batch.column(3).to_pylist()]
            take = pa.array(np.repeat(np.arange(len(found)), [len(t) for t, _ in found]))
            token, place = (np.concatenate([x[k] for x in found] or [np.zeros(0, np.uint64)]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(take) for k in range(3)], pa.array(token.astype(np.uint64).view(np.int64)), pa.array(place.astype(np.int64))],
                ["id", "n", "component", "token", "place"],
            )

    return map_batches(sets.select("id", "n", "component", "shingles"), run, "id long, n long, component long, token long, place long")


def _rest(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components whose prefixes meet where enough can follow."""
    tokens = materialize(_prefixes(sets), "prefixes")
    mixed = tokens.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("token")
    left = materialize(tokens.join(mixed, "token", "left_semi"), "mixed-prefixes")
    right = left.select("token", F.col("id").alias("v"), F.col("n").alias("of"), F.col("component").alias("other"), F.col("place").alias("at"))
    both = left.join(right, "token").where("id > v and component <> other")
    a, b = SIMILAR
    both = both.where(f"least(n - place, of - at) * {a + b} >= (n + of) * {a}")
    return both.select(F.col("id").alias("u"), "v").distinct()


def near_copies(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and component_id (its group's smallest doc_id) of each row of docs that has a doc_id."""
    docs = docs.where("doc_id is not null")
    sketches = materialize(_sketches(docs, width), "sketches")
    distinct = sketches.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("times"))
    distinct = materialize(distinct, "distinct-sets")
    members = distinct.select("id", "doc_id", "n", F.explode("bands").alias("key")).union(materialize(_alike(sketches), "fingerprint-members"))
    buckets = members.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min_by("n", "id").alias("of"), F.count(F.lit(1)).alias("times"))
    buckets = materialize(buckets.where("first < last").drop("last"), "buckets")
    members = materialize(join_skewed(members, buckets, ["key"], "times"), "bucket-members")
    size = f"least(n, of) * {SIMILAR[1]} >= greatest(n, of) * {SIMILAR[0]}"
    tried = materialize(members.where("id <> first").where(size).select(F.col("id").alias("u"), F.col("first").alias("v")).distinct(), "near-copy-pairs")
    sets = materialize(_sets(docs, members.select("id", "doc_id").distinct(), width), "shingle-sets")
    links = materialize(_linked(tried, sets), "near-copy-links")

    groups = components(links).withColumnRenamed("node", "id")
    members = members.select("key", "id", "n").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = materialize(members, "grouped-members")
    mixed = members.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    left = members.join(mixed, "key", "left_semi").select("id", "n", "component").distinct()
    rest = materialize(_rest(materialize(left.join(sets, "id"), "mixed-sets")).join(tried, ["u", "v"], "left_anti"), "near-copy-rest")
    if rest.head(1):
        links = links.union(_linked(rest, sets))
    # sets of rows that share a doc_id are one document's
    several = sketches.groupBy("doc_id").agg(F.min("id").alias("v"), F.max("id").alias("last")).where("v < last").drop("last")
    links = links.union(sketches.join(several, "doc_id").select(F.col("id").alias("u"), "v").where("u <> v"))
    moved = components(links).where("node <> component").withColumnRenamed("node", "id")
    placed = distinct.join(moved, "id", "left").withColumn("group", F.coalesce("component", "id"))
    placed = materialize(placed.select("id", "doc_id", "group", "times"), "placed-sets")
    firsts = placed.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    by_set = materialize(placed.join(firsts, "group").select("id", "component_id", "times"), "set-components")
    return join_skewed(sketches.select("doc_id", "id"), by_set, ["id"], "times").select("doc_id", "component_id")
