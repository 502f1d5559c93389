"""Connected components by alternating star rounds, each a written table; nodes are longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import checkpointed


def _larger(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours point to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    near = both.where("v > u").join(least, "u")
    return near.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _smaller(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    return edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()


def components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` of every node of ``links(u, v)``; the root is the smallest node that it reaches.

    The number of rounds grows with the logarithm of the nodes; a node with very many neighbours is one key of joins
    whose other side has a row a key, so the planner can split it.
    """
    ends = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges, seen = checkpointed(links.where("u <> v").select(*ends).distinct()), None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, edges = now, checkpointed(_smaller(_larger(edges)))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
