"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casesignal.session import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, its smallest reachable node, for every linked node.

    Each round points the neighbours of a node at the smallest of them, first
    the larger ones, then the smaller ones, until every node points at a root.
    A round is written to the shared folder, so a lost executor costs no more
    than that round. Links stay distributed; a hot node's links are joined, not
    gathered.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = stored(links.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "links")
    before = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "links")
        # A fixed point: the same links, told by their number and two sums.
        u, v = F.xxhash64("u", "v"), F.xxhash64("v", "u")
        now = edges.agg(F.count("*"), F.bit_xor(u), F.bit_xor(v)).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    up = both.where("v > u").join(least, "u")
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the smallest."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return down.unionByName(own).where("u <> v").distinct()
