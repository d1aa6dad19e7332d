"""Connected components of undirected links, by alternating star steps on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.llm.tables import staged


def _least(links: DataFrame) -> DataFrame:
    """The smallest neighbour of each ``a``; partial minima keep a hot node cheap."""
    return links.groupBy("a").agg(F.min("b").alias("least"))


def _outward(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour, or the node."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).withColumn("least", F.least("a", "least"))
    found = both.where(F.col("b") > F.col("a")).join(least, "a")
    return found.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _inward(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = _least(links)
    moved = links.join(least, "a").where(F.col("b") != F.col("least"))
    kept = least.select("a", F.col("least").alias("b"))
    return moved.select(F.col("b").alias("a"), F.col("least").alias("b")).union(kept).distinct()


def _print(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node it can reach.

    Links of a node with itself and links with null ends count for nothing, and nodes
    without others have no row. Each step is written to the shared folder; the steps end
    when the links stay as they are, after a number that grows with the logarithm of the nodes.
    """
    proper = links.where(F.col("a") != F.col("b"))
    larger = proper.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = staged(larger.distinct(), "links")
    seen = _print(now)
    while seen[0]:
        following = staged(_inward(_outward(now)), "links")
        mark = _print(following)
        now, seen, before = following, mark, seen
        if mark == before:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b"), F.col("b"))).distinct()
