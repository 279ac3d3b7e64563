"""Connected components of an edge table by alternating large and small stars, with a written table after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import scratch


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(x, y): each node that is not the smallest of its component, and the smallest.

    Edges with a null end or equal ends are ignored. A node's neighbours are never gathered: each round takes map-side
    minima and joins them back, so a node with many neighbours is no hot group.
    """
    spark = edges.sparkSession
    cur = scratch(spark, edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where(f"{a} is not null and {b} is not null").where("x != y").distinct(), "edges")
    seen = _state(cur)
    while seen[0]:
        both = cur.select("x", "y").unionByName(cur.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y").unionByName(low.select("x", F.col("m").alias("y"))).distinct()
        cur = scratch(spark, small, "stars")
        now = _state(cur)
        if now == seen:
            break
        seen = now
    return cur
