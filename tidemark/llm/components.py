"""Connected components of a graph of any size, as DataFrame joins (alternating stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Links in a partition of a round's result, about: small graphs don't leave a file for every shuffle partition.
PART_ROWS = 100_000


def _outward(edges: DataFrame) -> DataFrame:
    """Large star: every node links its larger neighbours to the smallest node around it."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _inward(edges: DataFrame) -> DataFrame:
    """Small star: every node links its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or is only the smaller end of links."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 OR (up = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (columns a, b; of one orderable type); component is its smallest node.

    Null ends and links of a node to itself are left out. Each round is written to the checkpoint
    folder, so a lost executor costs one round; the number of rounds grows with the logarithm of the
    longest chain. Only a row count and a yes or no come to the driver. No links give an empty result.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    parts = 1 + links.count() // PART_ROWS
    while not links.isEmpty():
        links = cut(_inward(_outward(links.coalesce(parts)).coalesce(parts)).coalesce(parts))
        if _all_stars(links):
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
