"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import cut_lineage, forget


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: longs), root being the smallest node reachable.

    Alternates large-star and small-star steps until the links are stars around their smallest nodes.
    A hub's links meet only its one minimum, so they are combined before the shuffle
    and a hub's join can be split. The links and each round are written to the shared folder, so the
    driver plans what ``links`` come from once, not once for each of a round's reads.
    Nulls and self-links are left out; an empty table gives an empty result.
    """
    edges = links.where("a is not null and b is not null and a <> b")
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(edges):
        last, edges = edges, cut_lineage(_small_star(_large_star(edges)))
        forget(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end of a link has that link only."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("larger")).union(edges.select("v", F.lit(0)))
    ends = ends.groupBy("node").agg(F.sum("larger").alias("links"), F.min("larger").alias("least"))
    return not ends.agg(F.count_if(F.expr("links > 1 or links = 1 and least = 0"))).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node next to it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the smallest of them."""
    edges = edges.where("u <> v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
