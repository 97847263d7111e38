"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b); the component is its smallest node.

    Alternates two steps until nothing changes: every larger neighbour of a node is tied to the
    node's smallest neighbour, then every smaller one and the node itself are.  Both are a minimum
    for each node and a join, so that a node with very many links is no single group.
    """
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # Each pair (v, m) of a node whose smallest neighbour is m, and the node's own (u, m).
        near = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = near.select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m").alias("y")), F.struct(F.col("u").alias("x"), F.col("m").alias("y")))).alias("p"))
        e = cut(pairs.select(F.greatest("p.x", "p.y").alias("u"), F.least("p.x", "p.y").alias("v")).where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
