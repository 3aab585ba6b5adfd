"""Connected components of an edge table by contraction, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): for every node of an edge, the least node that it reaches.

    In each round a node hooks to its least neighbour if that is smaller, and the edges are
    drawn anew between what remains; a round leaves at most half of the nodes that still have
    edges. Hubs are combined before the shuffle, and the joins have one row per node on one side.
    """
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("up")))
        jump = hook.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        hook = cut(hook.join(jump, "up").select("node", F.col("upper").alias("up")))  # two steps at once
        if found is None:
            found = hook.select("node", F.col("up").alias("component"))
        else:
            step = hook.select(F.col("node").alias("component"), "up")
            found = cut(found.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        left = hook.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = hook.select(F.col("node").alias("b"), F.col("up").alias("y"))
        moved = edges.join(left, "a").join(right, "b").filter("x <> y")
        edges = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
