"""Connected components by hooking and pointer jumping over contracted edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): component is the smallest node that is reachable.

    Each round hooks every node to its smallest neighbour, jumps pointers to the roots and contracts the edges;
    a component's local minima at least halve. All state is in staged tables; nothing is collected.
    """
    edges = staged(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("p"), F.lit(True).alias("moved")), "parents")
        while not parents.where("moved").isEmpty():
            up = parents.select(F.col("node").alias("p"), F.col("p").alias("_up"))
            parents = staged(parents.join(up, "p").select("node", F.col("_up").alias("p"), (F.col("_up") != F.col("p")).alias("moved")), "parents", instead_of=parents)
        root = parents.select("node", "p")
        before = labels
        if labels is None:
            labels = root.withColumnRenamed("p", "component")
        else:
            labels = labels.join(root.select(F.col("node").alias("component"), "p"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        labels = staged(labels, "labels", instead_of=before)
        contracted = edges.join(root.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a").join(root.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
        edges = staged(contracted.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges", instead_of=edges)
        unstage(parents)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
