"""Distributed connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node below the node's smallest neighbour."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.filter("v > u")
        .join(lowest, "u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours below the smallest of them."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node in ``links``; component is its smallest reachable node.

    Direction, repeats, self links and links with a null end don't matter. Every round is
    written to the shared folder; the number of rounds grows with the logarithm of the longest
    path. The neighbours of a node are never gathered: only their minimum is.
    """
    u, v = F.col(left), F.col(right)
    edges = links.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    edges = staged(edges, "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if tuple(state) == before or state[0] == 0:
            break
        before = tuple(state)
        edges = staged(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
