"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrite.llm.shared import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) for every id in the edges ``a, b``.

    Each round every id moves to its smallest neighbour, and on to that one's; then the edges are drawn between where
    their ends have moved and those that join nothing any more go. So a star takes a round or two, a path about the
    logarithm of its length, and the edges get fewer each round. Everything stays distributed in written tables.
    Self-loops and repeated edges don't matter; edges with a null end are dropped.
    """
    left = cut(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = left.select(F.col("a").alias("id"), F.col("a").alias("component")).where("false")
    while not left.isEmpty():
        step = left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to"))
        further = step.select(F.col("id").alias("to"), F.col("to").alias("further"))
        step = cut(step.join(further, "to", "left").select("id", F.coalesce("further", "to").alias("to")))
        moved = labels.join(step.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        labels, old = cut(moved.union(step.select("id", F.col("to").alias("component")))), labels
        ends = left.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a", "left").join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        x = F.coalesce("x", "a")
        left, gone = cut(ends.where(x != F.col("y")).select(F.least(x, "y").alias("a"), F.greatest(x, "y").alias("b")).distinct()), left
        drop(gone, step, *[old] * hasattr(old, "_papyrite_folder"))
    # an id that others moved to while it moved itself is there twice
    return labels.union(labels.select(F.col("component").alias("id"), "component")).distinct()
