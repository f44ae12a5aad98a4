"""Connected components of an edge table by alternating large and small stars.

Each round is two grouped minima and two equi-joins, all hash-partitioned;
hot nodes (the centre of a large group) meet in sort-merge joins, which AQE
splits, and in minima, which are summed before the shuffle. Each round's edges
are checkpointed, so a lost executor costs one round at most. The number of
rounds grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import materialise


def _stars(edges: DataFrame, low_only: bool) -> DataFrame:
    """Small star (low_only): join a node's smaller neighbours and itself to the least of them. Large star: its larger neighbours."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    near = down if low_only else down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    if not low_only:
        least = least.select("u", F.least("u", "m").alias("m"))
    moved = near.join(least, "u")
    if low_only:
        linked = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        linked = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root: the smallest node it reaches.

    Loops, repeated edges and either direction are fine; edges with a null end
    are ignored; no edges give no rows.
    """
    current = materialise(edges.select(edges[a].alias("a"), edges[b].alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == state or not state[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        mark = state
        current = materialise(_stars(_stars(current, low_only=False), low_only=True))
