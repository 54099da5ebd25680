"""Connected components of an edge table by alternating large and small stars.

Each round is a grouped minimum (combined before the shuffle) and a join that
adaptive execution can split, so a node with very many edges does not end up
in one task. Rounds are written to the shared folder; the driver sees a count
and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least_neighbours(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours as m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _least_neighbours(both).where("v > u")
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come with u > v."""
    found = _least_neighbours(edges)
    links = found.select(F.col("v").alias("u"), F.col("m").alias("v")).union(found.select("u", F.col("m").alias("v")))
    return links.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of an edge; component: its smallest reachable node.

    edges: u and v, longs in any order; loops, repeats and nulls are allowed
    (null ends are ignored). An empty table gives an empty table.
    """
    now = edges.where("u is not null and v is not null and u <> v")
    now = materialize(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = state
        now = materialize(_small_star(_large_star(now)), "edges")
