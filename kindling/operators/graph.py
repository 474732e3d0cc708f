"""Connected components of an edge list, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.operators.shared import counted_join, cut


def linked(edges: DataFrame) -> DataFrame:
    """node and root, its smallest reachable node, for every node on an edge (u, v) that isn't a root itself.

    Large-star and small-star steps alternate: each node hands the larger of its neighbours, then the
    smaller ones, to the least of them. Edges never grow in number, every component ends as a star
    around its smallest node, and rounds grow with the logarithm of its size. Each round is written to the shared
    folder. A node with very many neighbours is broadcast to them, not gathered with them.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    total, mark = edges.count(), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = cut(counted_join(both, least, ["u"], 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = counted_join(large, least, ["u"], total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        total, *now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (total, now) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (total, now)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component, its smallest reachable node, for every row of `nodes`; edges (u, v)."""
    return nodes.select("node").join(linked(edges), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
