"""Connected components of an edge table in a number of rounds that grows with the logarithm of their size.

Rounds of two star operations (large star, then small star): every node's larger
neighbours move to the least node it sees, then its smaller neighbours do. Both are
a partially aggregated minimum per node and a join on it; edges are checkpointed
after each round and nothing is collected but one row of counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of an edge table ``(u, v)``; the root is the least node of the component."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    mark = None
    while True:
        e = _small_star(_large_star(e)).checkpoint()
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))
