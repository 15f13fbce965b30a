"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stored


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b, m): m is the least b of a. It is found by partial aggregation and joined, so a hot star is never one task's group."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of ``edges`` (a, b), root being the least node of its component.

    Any orderable type serves as node. Loops, null ends, repeated edges and either direction are fine; an empty table gives
    an empty one. Steps are joins of the remaining edges, written to the shared folder, until nothing changes (the published
    bound is the square of the logarithm of the nodes); a star's centre never collects its neighbours.
    """
    now = Stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.df.union(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        small = _with_least(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        then = Stored(small)
        now.drop()
        now = then
        seen = now.df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen[0] == 0 or tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
