"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b), component the smallest node that it reaches.

    Contraction: every node goes to the least of itself and its neighbours, and an edge to where its
    ends went, until no edge is left between two nodes; a node's labels of all rounds, one after the
    other, lead to its component. Each round aggregates before it shuffles, works on what the round
    before left, and is written to the shared folder, so that no lineage grows and no group of a hub
    is gathered. Nodes are best numbered at random, as hashes are: then the rounds are few. An empty
    edge table gives an empty result; self-loops count as nodes of their own; repeated edges count once.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    labels: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        least = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).groupBy("x.a").agg(F.min("x.b").alias("m"))
        least = materialize(least.select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "cc")
        labels.append(least)
        side = lambda x: least.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}"))  # noqa: B023, E731
        moved = now.where("a <> b").join(side("a"), "a").join(side("b"), "b").where("to_a <> to_b")
        now = materialize(moved.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct(), "cc")
        if now.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    found = labels.pop()
    while labels:  # where a node went in a round, and where that went in later ones
        later = found.select(F.col("node").alias("to"), F.col("to").alias("component"))
        found = labels.pop().join(later, "to", "left").select("node", F.coalesce("component", "to").alias("to"))
    return found.withColumnRenamed("to", "component")
