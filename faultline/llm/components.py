"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import materialise


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each node, stored: otherwise the join with ``edges`` would
    reuse this shuffle, and Spark does not split the edges of a hub then."""
    return materialise(edges.groupBy("a").agg(F.min("b").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.union(edges.select("b", "a"))
    least = _least(both)
    return (
        both.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    linked = down.join(least, "a").select("b", "m").where("b <> m")
    return linked.union(least.select("a", "m")).distinct().toDF("a", "b")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node of its component).

    edges: two columns of one orderable type; loops and repeats do no harm. Nodes
    without an edge are not returned. Large-star and small-star steps alternate
    until nothing changes, in a number of rounds that grows with the logarithm of
    the size. A hub is no group: a step only joins edges with the least neighbour
    of each node. Each round is written to the shared folder.
    """
    edges = materialise(edges.toDF("a", "b").where("a <> b").distinct())
    state = None
    while True:
        found = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if found == state or not found[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select("b", "b").distinct()
            )
        state = found
        edges = materialise(_small_star(materialise(_large_star(edges))))
