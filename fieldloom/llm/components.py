"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest among them.

    The smallest neighbour is an aggregate with map-side combination and the way
    back is a plain join, so a node with very many neighbours is split by Spark.
    """
    both = edges if small else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    joined = both.join(least, "a")
    if small:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select("a", F.col("least").alias("b"))
        )
    else:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.filter("a > b").distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)`` but the smallest of each component.

    The component is its smallest node. Every round is written to shared storage.
    """
    edges = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges"
    )
    before = _sum(edges)
    while before[0]:
        edges = written(_star(written(_star(edges, small=False), "large-star"), small=True), "small-star")
        after = _sum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
