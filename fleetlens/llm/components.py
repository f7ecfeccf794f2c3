"""Connected components of a graph that is too large for one machine, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored


def digest(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges: their count and the sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` from edges ``a, b``: the smallest node that can be reached, for every node of an edge.

    Each round points the larger neighbours of a node to its smallest neighbour, then the node and its smaller
    neighbours likewise; path lengths shrink until each component is a star. A node's smallest neighbour is an
    aggregate that is combined before the shuffle and joined back, so a node with very many neighbours is never one
    group in one task. Each round is written to the shared folder. Edges with a null end or from a node to itself
    count for nothing; repeated edges count once.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = stored(ends.where("u > v").distinct(), "stars")
    before, state = None, digest(stars)
    while state != before:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        lower = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stored(lower.unionByName(small.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "stars")
        before, state = state, digest(stars)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
