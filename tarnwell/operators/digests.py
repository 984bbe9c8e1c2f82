"""Identity of tables: digest trees over ranges of the keys' hashes, whose root says whether two tables are equal and whose branches say where not.

A row's range is the head of its key's digest, so the tree depends on the rows alone, not on partitions, order or statistics, and hot
neighbourhoods of keys spread over all ranges. A range's digest is the sum of its rows' digests, which is added up before anything is
shuffled; above that a node's digest covers those of its sixteen children in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..sources.outputs import flat_line


def key_range(key: Sequence[str], depth: int) -> Column:
    """The range of a row: the first ``depth`` hexadecimal digits of its key's digest."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in key]
    return F.left(F.sha2(F.concat_ws("\0", *parts), 256), F.lit(depth))


def digest_tree(df: DataFrame, key: Sequence[str], depth: int = 3) -> DataFrame:
    """(level, range, n, digest) of all ranges that hold rows: 16^depth at most at level ``depth``, up to the root at level 0 (range '').

    Rows count with their repeats. An empty table has a tree of its root alone.
    """
    one = F.sha2(flat_line(df), 256)
    parts = [F.conv(F.substring(one, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16, 31, 46)]
    sums = df.select(key_range(key, depth).alias("range"), *[p.alias(f"_{i}") for i, p in enumerate(parts)]).groupBy("range").agg(F.count("*").alias("n"), *[F.sum(f"_{i}").alias(f"_{i}") for i in range(4)])
    leaf = F.sha2(F.concat_ws("|", "n", *[f"_{i}" for i in range(4)]), 256)
    level = stored(sums.select(F.lit(depth).alias("level"), "range", "n", leaf.alias("digest")), "digests")
    tree = level
    for up in range(depth - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("range", "digest")))  # sixteen at most
        level = level.groupBy(F.left("range", F.lit(up)).alias("range")).agg(F.sum("n").alias("n"), F.sha2(F.to_json(children), 256).alias("digest")).select(F.lit(up).alias("level"), "range", "n", "digest")
        tree = tree.unionByName(level)
    if not level.take(1):
        return df.sparkSession.createDataFrame([(0, "", 0, "")], tree.schema)
    return tree


def root(tree: DataFrame) -> str:
    return tree.where("level = 0").first()["digest"]


def differing_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(range) of the finest ranges in which two trees of one depth differ, found from the root down: each level looks at the children of differing ranges only."""
    depth = max(t.agg(F.max("level")).first()[0] for t in (a, b))
    found = a.where("level = 0").select("range")
    for level in range(depth + 1):
        of = lambda t, name, level=level: t.where(F.col("level") == level).select("range", F.col("digest").alias(name), F.left("range", F.lit(max(0, level - 1))).alias("_up"))
        x, y = (of(t, n).join(found.withColumnRenamed("range", "_up"), "_up", "left_semi").drop("_up") for t, n in ((a, "_x"), (b, "_y")))
        found = stored(x.join(y, "range", "full_outer").where(~F.col("_x").eqNullSafe(F.col("_y"))).select("range"), "differing")
        if not found.take(1):
            break
    return found


def row_changes(a: DataFrame, b: DataFrame, key: Sequence[str], ranges: DataFrame, depth: int = 3) -> DataFrame:
    """(key.., change) of rows of the given ranges that are in one table only (removed, added) or differ (changed). Keys are unique in each table."""
    head = key_range(key, depth).alias("range")
    near = [t.select("*", head).join(F.broadcast(ranges), "range", "left_semi").select(*key, F.sha2(flat_line(t), 256).alias(n)) for t, n in ((a, "_x"), (b, "_y"))]
    both = near[0].join(near[1], list(key), "full_outer").where(~F.col("_x").eqNullSafe(F.col("_y")))
    return both.select(*key, F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").otherwise("changed").alias("change"))
