"""Connected components of an edge table, by alternating star contraction.

Each round every node's larger neighbours are tied to its least neighbour (large star), then every node's
smaller neighbours likewise (small star), until nothing changes; the rounds grow with the logarithm of the
nodes. All of it stays in tables: minima are reduced in each task before the shuffle, and a round ends with
a written table; the one before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.coalesce(F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40))), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), root the least node of its component."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = materialize(now, "edges")
    seen = _digest(now)
    while seen[0]:
        both = _both(now)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: every larger neighbour of a node to the node's least neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: a node and its smaller neighbours to the least of these
        tied = large.join(least, "a")
        small = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, materialize(small, "edges")
        discard(before)
        found = _digest(now)
        if found == seen:
            break
        seen = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
