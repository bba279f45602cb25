"""Connected components of an edge table by alternating large and small stars; nothing of the graph reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .base import free_shuffles, staged, unstage


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b long, no nulls) to (node, component): the smallest node reachable, for every node with an edge to another.

    Each round a large star links every larger neighbour of a node to the node's smallest neighbour, and a small star the smaller ones;
    both keep components and shrink paths to a star in O(log^2) rounds. Minima are pre-aggregated and joined back, so a hub is a
    skewed join that Spark can split and never one task's list. Self loops and repeated edges are allowed.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    # done when every edge leads from a node that has no other to one that leads nowhere: all components are stars then
    while not now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() or not now.groupBy("a").count().where("count > 1").isEmpty():
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small_low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = staged(star.select("e.a", "e.b").where("a <> b").distinct())
        unstage(now)
        now = after
        free_shuffles(edges.sparkSession)
    out = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = out.select(F.col("component").alias("node"), "component").distinct()
    return out.unionByName(roots)
