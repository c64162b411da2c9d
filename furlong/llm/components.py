"""Connected components of a graph given by its edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.session import materialize


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Every node a links neighbours (larger ones, or all smaller ones) to its least neighbour."""
    if large:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select("b", "m").union(least.select("a", "m")).toDF("a", "b")
    return out.where("a <> b").distinct()


def components(spark, edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the least node of its component. Rounds follow until nothing
    changes; their number grows with the logarithm of the largest component."""
    pairs = materialize(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        pairs = materialize(spark, _star(_star(pairs, True), False), "stars")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
