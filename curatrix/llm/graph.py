"""Connected components by alternating large-star and small-star steps over a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import checkpointed


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, root (the smallest node reachable) for every node that has a link. Links stay distributed; each round is
    a few aggregations and joins, cut by a checkpoint. Null ends and loops are ignored."""
    both = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where((F.col(u).isNotNull()) & (F.col(v).isNotNull()) & (F.col("u") != F.col("v")))
    edges = checkpointed(both.distinct())
    state = _state(edges)
    while state[0]:
        way = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = way.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = way.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = checkpointed(small.where(F.col("u") != F.col("v")).distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], row[1]
