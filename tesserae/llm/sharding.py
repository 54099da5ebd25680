"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (key, tie), two non-negative longs. The driver holds a
candidate interval for each of the n-1 splitters; every round sums the exact
bytes of the rows that fall in equal-width bins of those intervals, and each
splitter's interval shrinks to the bin that holds its target. A splitter is
settled once a bin edge lies within the tolerance of its target; where one key
alone (a group of equal texts) is wider than the tolerance, the same search
goes on over ``tie`` inside that key, so a hot group is divided and not
dropped on one shard. The driver sees bins * (n-1) sums a round and never rows.
Then the rows are exchanged once, by (shard, slice), and numbered.

Law ``bytes``: the shards' byte totals differ from the mean by no more than the
tolerance or, if that is more, by one row (or one run of wholly equal rows).

Defined results: an empty table gives an empty table; a null size counts as 0;
fully repeated rows have equal (key, tie) and stay on one shard; nulls and
clashing names in other columns are carried along (internal columns start with
``__hs_``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, text_or_empty

#: Splitter search: bins of an interval a round.
BINS = 256
#: Part of a shard's ideal bytes by which a splitter may miss its target.
TOLERANCE = 0.005
#: Slices of a shard that are numbered separately; bounds a numbering task and the broadcast offsets.
SLICES = 256
TOP = 1 << 63


@dataclass
class Probe:
    """The interval [lo, hi) that holds a splitter: of keys, or of ties within the key ``at``."""

    target: float
    below: int = 0
    lo: int = 0
    hi: int = TOP
    at: int | None = None
    done: tuple[int, int] | None = None

    def edge(self, value: int) -> tuple[int, int]:
        return (value, 0) if self.at is None else (self.at, value)


def _long(value: int) -> Column:
    return F.lit(min(value, TOP - 1)).cast("long")


def _inside(p: Probe) -> Column:
    col = "__hs_key" if p.at is None else "__hs_tie"
    held = (F.col(col) >= _long(p.lo)) & ((F.col(col) < _long(p.hi)) if p.hi < TOP else F.lit(True))
    return held if p.at is None else held & (F.col("__hs_key") == _long(p.at))


def _histogram(slim: DataFrame, spaces: list[Probe], bins: int) -> dict[tuple[int, int], int]:
    """Exact bytes by (interval, bin), counted over all partitions."""
    expr = F.lit(None).cast("long")
    for i, p in enumerate(spaces):
        step = -(-(p.hi - p.lo) // bins)
        col = "__hs_key" if p.at is None else "__hs_tie"
        expr = F.when(_inside(p), F.lit(i * bins) + F.expr(f"({col} - {p.lo}L) div {step}L")).otherwise(expr)
    wanted = reduce(lambda a, b: a | b, [_inside(p) for p in spaces])
    rows = slim.where(wanted).groupBy(expr.alias("bin")).agg(F.sum("__hs_size").alias("bytes")).collect()
    return {divmod(r["bin"], bins): r["bytes"] for r in rows}


def splitters(slim: DataFrame, n_shards: int, tolerance: float = TOLERANCE, bins: int = BINS) -> list[tuple[int, int]]:
    """The n-1 (key, tie) boundaries at which shards begin."""
    total = slim.agg(F.sum("__hs_size")).first()[0] or 0
    slack = tolerance * total / n_shards
    probes = [Probe(total * j / n_shards) for j in range(1, n_shards)]
    while open_ := [p for p in probes if p.done is None]:
        spaces = list({(p.at, p.lo, p.hi): p for p in open_}.values())
        place = {(p.at, p.lo, p.hi): i for i, p in enumerate(spaces)}
        sums = _histogram(slim, spaces, bins)
        for p in open_:
            i, step = place[p.at, p.lo, p.hi], -(-(p.hi - p.lo) // bins)
            below, b, here = p.below, 0, 0
            for b in range(bins):
                here = sums.get((i, b), 0)
                if below + here >= p.target:
                    break
                below += here
            lo, hi = p.lo + b * step, min(p.lo + (b + 1) * step, p.hi)
            before, after = p.target - below, below + here - p.target
            if min(abs(before), abs(after)) <= slack:
                p.done = p.edge(lo if abs(before) <= abs(after) else hi)
            elif hi - lo > 1:
                p.below, p.lo, p.hi = below, lo, hi
            elif p.at is None:
                p.below, p.at, p.lo, p.hi = below, lo, 0, TOP
            else:
                p.done = p.edge(lo if before <= after else hi)
    return sorted(p.done for p in probes)


def histogram_shard(
    df: DataFrame, size: Column, key: Column, tie: Column, n_shards: int = 8,
    tolerance: float = TOLERANCE, slices: int = SLICES,
) -> DataFrame:
    """df's columns with law, shard (0 to n-1), slot (gapless from 0 in its shard) and grown_shard.

    key and tie: longs of 0 or more (see ``spread``); rows of equal key form a
    group, kept whole unless it is wider than the tolerance.
    """
    kept = df.drop(*[c for c in ("law", "shard", "slot", "grown_shard") if c in df.columns])
    work = kept.withColumns({"__hs_size": F.coalesce(size.cast("long"), F.lit(0)), "__hs_key": key, "__hs_tie": tie})
    slim = materialize(work.select("__hs_size", "__hs_key", "__hs_tie"), "sharding")
    cuts = splitters(slim, n_shards, tolerance)

    def place(d: DataFrame) -> DataFrame:
        at_or_after = [
            ((F.col("__hs_key") > _long(k)) | ((F.col("__hs_key") == _long(k)) & (F.col("__hs_tie") >= _long(t)))).cast("int")
            for k, t in cuts
        ]
        shard = reduce(lambda a, b: a + b, at_or_after, F.lit(0))
        return d.withColumns({"shard": shard, "__hs_slice": F.pmod(F.xxhash64("__hs_key", "__hs_tie"), F.lit(slices)).cast("int")})

    counts = place(slim).groupBy("shard", "__hs_slice").agg(F.count(F.lit(1)).alias("__hs_n"))
    before = Window.partitionBy("shard").orderBy("__hs_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__hs_slice", F.coalesce(F.sum("__hs_n").over(before), F.lit(0)).alias("__hs_off"))
    within = Window.partitionBy("shard", "__hs_slice").orderBy("__hs_key", "__hs_tie")
    numbered = place(work).withColumn("__hs_rn", F.row_number().over(within))
    # at most n_shards * slices rows, whatever the input
    joined = numbered.join(F.broadcast(offsets), ["shard", "__hs_slice"])
    return joined.select(
        *[F.col(f"`{c}`") for c in kept.columns], F.lit("bytes").alias("law"), "shard",
        (F.col("__hs_off") + F.col("__hs_rn") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def spread(*cols: Column) -> Column:
    """A non-negative long that spreads values evenly: equal values, equal longs."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Documents with near-equal bytes a shard; equal texts share a shard where the tolerance allows."""
    text = text_or_empty()
    return histogram_shard(docs, F.octet_length(text) + 1, spread(text), spread(F.col("doc_id")), n_shards)


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards, by bytes: the texts are exchanged, and digested where they arrive."""
    out = shard_documents(documents(spark, sf_dir).select("doc_id", "text"), 8)
    text = text_or_empty()
    size = (F.octet_length(text) + 1).cast("long").alias("size")
    return out.select("doc_id", size, F.crc32(text).alias("text_crc32"), "law", "shard", "slot", "grown_shard")
