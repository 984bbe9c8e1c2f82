"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node but the roots of the graph ``edges`` (u, v); the root is the least node of its component.

    Rounds follow the logarithm of the longest path. Each is a few joins and minima by key, written to the shared folder; no
    component is gathered. Loops and repeated edges do no harm; no edges give no rows.
    """
    now = written(edges.where(F.col("u") != F.col("v")).distinct(), "edges")
    was = None
    while (mark := _print(now)) != was:
        was = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        down = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        after = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(now)
        discard(down)
        now = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
