"""Connected components over an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


BROADCAST_ROWS = 100_000  # minima (16 bytes each) are broadcast up to this many, joined by a shuffle beyond


def _star(scratch: Scratch, edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over edges (u, v) in both directions or from larger to smaller.

    The minimum of a neighbourhood is an aggregate (combined before the shuffle), written and joined back to its
    edges: broadcast where there are few, else by a shuffle whose large partitions Spark may split.  So a node
    with very many neighbours is never gathered into one row or task.
    """
    low = scratch.write(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
    joined = edges.join(F.broadcast(low) if low.count() <= BROADCAST_ROWS else low, "u")
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    out = scratch.write(out.filter("u <> v").distinct(), "large-star" if larger else "small-star")
    scratch.drop(low)
    return out


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component): every node of the edges (a, b) with the smallest node it can reach.

    Each round points larger neighbours at a node's minimum, then the node and its smaller neighbours;
    it ends when only stars are left, after a number of rounds logarithmic in the longest path.
    Null ends, loops and repeated edges are ignored; an empty table gives an empty table.
    """
    now = scratch.write(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = _star(scratch, both, True)
        new = _star(scratch, big, False)
        scratch.drop(now, big)
        now = new
        forks = now.groupBy("u").count().filter("count > 1").select("u")
        chains = now.select("u").join(now.select(F.col("v").alias("u")), "u", "left_semi")
        if forks.union(chains).isEmpty():  # every edge leads straight to a root: nothing can change
            break
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
