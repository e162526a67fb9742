"""Connected components by alternating large-star and small-star steps, all as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. ``edges``: (a, b) with a < b. Every node sends its larger (large) or smaller (small) neighbours to
    its smallest one. The minima are a combined aggregate and a table of their own, so that Spark can split the join at a
    hub: its neighbours are never gathered in one task."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")), "least")
        moved = near.join(least, "a").where("b > a").select(F.col("root").alias("a"), "b")
    else:
        least = stored(edges.groupBy("b").agg(F.min("a").alias("root")), "least")
        pairs = edges.join(least, "b")
        moved = pairs.select(F.col("root").alias("a"), F.col("a").alias("b")).unionByName(
            pairs.select(F.col("root").alias("a"), "b")
        )
    return moved.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the (a, b) edges of longs that is not the smallest of its component.

    Nulls and loops are ignored; repeated edges count once; no edges give an empty table. Each round ends in a table
    in the shared folder; rounds go on until the edges are stars round their smallest node.
    """
    now = stored(
        edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    seal = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == seal or not new[0]:
            break
        seal, before = new, now
        now = stored(_star(stored(_star(before, True), "half"), False), "edges")
        forget(before)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
