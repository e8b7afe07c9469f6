"""Connected components of a graph in a table, by alternating large and small stars. Nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from packetloom.session import settled

_ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.max(F.col("a") != F.col("b")).alias("any")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); the component is its smallest node.

    Each round points all larger neighbours of a node at its smallest one, then all smaller neighbours; a long chain shrinks by a
    factor in each round. A node with very many neighbours is reduced before it is shuffled, and what is joined back is split by
    adaptive execution. Edges of a node with itself and repeated edges change nothing.
    """
    edges = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    for _ in range(_ROUNDS):
        if not before[0]:
            break
        # Large star: every larger neighbour of a node is tied to the node's smallest neighbour (or itself).
        near = _both_ways(edges)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every smaller neighbour, and the node itself, is tied to the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "a", "m")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        edges = settled(small.where("a <> b").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
