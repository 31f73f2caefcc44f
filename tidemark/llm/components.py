"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of the bigint link table ``(u, v)``.

    A component is named by its smallest node.  Links from a node to itself and
    repeated links change nothing; nodes without other links do not appear, and
    rows with a null are ignored.  Rounds grow with the logarithm of the number
    of nodes; a hub's links are joined, never gathered.  The result is a written
    table, which discard() deletes.
    """
    now = saved(links.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        after = saved(_small_star(_large_star(now)))
        discard(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            leaves, roots = now.select(F.col("u").alias("node"), F.col("v").alias("component")), now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            named = saved(leaves.union(roots))
            discard(now)
            return named
        mark = state
