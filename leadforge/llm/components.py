"""Connected components of an edge table by alternating large and small stars.

An edge runs from the larger node to the smaller one. Each round first moves
every edge's smaller end to the least neighbour of that end (large star), then
ties all smaller neighbours of a node to the least of them (small star); the
edges become stars whose centre is the component's least node. The least
neighbours are a partially aggregated, written table, so the join that meets it
has two freshly shuffled sides and adaptive execution can split the rows of a
star with very many points. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise


def _is_stars(edges: DataFrame) -> bool:
    """Whether every point has one centre and no centre is a point."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("point"), F.lit(0).alias("centre")).unionByName(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("point"), F.lit(1).alias("centre")))
    per_node = ends.groupBy("n").agg(F.sum("point").alias("p"), F.max("centre").alias("c"))
    return per_node.filter((F.col("p") > 1) | ((F.col("p") > 0) & (F.col("c") > 0))).isEmpty()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (two long columns); the root is the component's least node.

    Loops and repeated edges are ignored; without edges the result is empty.
    """
    e = materialise(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    while not _is_stars(e):
        least = materialise(e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least-neighbours")
        large = e.join(least, F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b"))
        # the points of a star stand on the smaller side only, so no node has many rows here
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        pairs = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        e = materialise(small.select(pairs.alias("p")).select("p.a", "p.b").filter("a <> b").distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
