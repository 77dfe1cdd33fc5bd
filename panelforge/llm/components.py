"""Connected components by alternating large and small stars, with the lineage cut after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them. In an edge, u is the larger one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): each node that has a link, with the smallest node it is connected with.

    Groups are only ever reduced to their least member, so no neighbourhood is gathered in one place."""
    larger, smaller = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges, before = cut(links.where("a <> b").select(larger, smaller).distinct()), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
        edges = cut(_small_star(_large_star(edges).distinct()).distinct())
    # every edge is now from a node to its root
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
