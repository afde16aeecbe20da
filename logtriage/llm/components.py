"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtriage.session import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on its smallest one: all larger than the node, or all not larger."""
    if large:
        links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least.withColumn("m", F.least("u", "m")), "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(joined.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every node with a link; a root is not listed itself.

    Every round is a minimum with map-side combining and a join, so a node with very many links is no hot group. Rounds
    grow with the logarithm of the longest chain.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = cut_lineage(links.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct())
    state = None
    while True:
        now = cut_lineage(_star(_star(now, large=True), large=False))
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
