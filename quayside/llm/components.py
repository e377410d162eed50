"""Connected components by alternating large and small stars over a stored table of edges.

Each round is two aggregations (minimum, combined before the shuffle) and two equi-joins; nothing is collected
but a count and a checksum. Rounds end when a round leaves the edges as they were: stars around the smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import Stored, free_shuffles


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: u, v (long, u > v). Returns node, root for all nodes of edges; root is the component's smallest node."""
    now = Stored(edges.filter("u > v").select("u", "v").distinct())
    mark = _mark(now.df)
    for _ in range(rounds):
        if not mark[0]:
            break
        e = now.df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = e.join(low, "v").select("u", F.col("m").alias("v")).distinct()
        large = Stored(large)
        low = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, Stored(small)
        last.drop()
        large.drop()
        free_shuffles(edges.sparkSession)
        was, mark = mark, _mark(now.df)
        if was == mark:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    stars = now.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
