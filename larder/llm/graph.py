"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import spill


def _round(directed: DataFrame, keep) -> DataFrame:
    """Links the chosen neighbours of every node u to u's least neighbour.

    The least neighbours are written first. Both sides of the join then come from plain exchanges, so that adaptive
    execution can split the rows of a hub over many tasks; the aggregate before it is combined on the map side.
    """
    least = spill(directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return directed.join(least, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b) that has an edge to another; root is the least node reachable.

    Self loops and repeated edges are allowed; edges with a null end are ignored. An empty table gives none.
    The driver holds two numbers a round.
    """
    edges = edges.where("a is not null and b is not null")
    edges = spill(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _round(both, F.col("v") > F.col("u"))
        large = spill(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = spill(down.groupBy("u").agg(F.min("v").alias("m")))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges_next = spill(small.where("a <> b").distinct())
        now = edges_next.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges_next = edges_next.select("a", "b")
        if now == before:
            break
        before, edges = now, edges_next
    stars = edges_next.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root")).distinct()
