"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every neighbour greater than a node is tied to the node's least neighbour instead."""
    both = scratch.put(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = scratch.put(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    scratch.drop(both)
    return out


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every node and its lesser neighbours are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    pairs = edges.join(least, "a")
    out = pairs.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return scratch.put(out.unionByName(least.select("a", F.col("m").alias("b"))).distinct())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges (a, b: longs, any order); root is the component's least node.

    Nodes that are their own root are left out. Each round writes the edges
    anew; nothing but their number and a checksum reaches the driver. Edges that
    repeat, of either order, or tie a node to itself change nothing; an edge
    with a null ties nothing; no edges give no rows. A star's centre has as many
    rows as neighbours in one join, of two longs each, which adaptive execution
    splits.
    """
    now = scratch.put(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        large = _large_star(now, scratch)
        nxt = _small_star(large, scratch)
        scratch.drop(now, large)
        now = nxt
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
