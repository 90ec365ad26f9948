"""Connected components by alternating large and small stars, in rounds cut by checkpoints.

Nodes of edges must not be null. Edges may repeat; an empty table gives no nodes. A round's tables are
removed once the next is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import cut, drop


def _are_stars(edges: DataFrame) -> bool:
    """Does every edge (u, v) lead from a node that has no other edge?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def components(edges: DataFrame, nodes: int) -> DataFrame:
    """node, root (the least node of its component) of all nodes that edges (u, v) touch.

    ``nodes`` bounds their number. Edges of a node and itself name nodes that may have no others. The
    minima are checkpointed before they are joined, so a star's hub is dealt anew like any skewed join.
    """
    edges = cut(edges.select("u", "v"), nodes)
    loops = edges.where("u = v").select(F.col("u").alias("node")).distinct()
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), nodes)
    while not _are_stars(e):
        before = e
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), nodes)
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), nodes)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), nodes)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.distinct(), nodes)
        drop(before, least, large, low)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    hubs = stars.select(F.col("root").alias("node")).unionByName(loops).distinct()
    alone = hubs.join(stars.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return stars.unionByName(alone)
