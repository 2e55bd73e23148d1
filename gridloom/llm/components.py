"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u, v) that is not the smallest of its component; root is that smallest.

    Each round hooks every neighbour to the smallest node around it. Smallest nodes come from aggregates that combine
    before the shuffle and are written to the shared folder before they are joined, so that both sides of each join are
    plain exchanges and Spark can split the rows of a hub. No lineage builds up and no link reaches the driver. Rounds
    grow with the logarithm of the longest path. Self-links and repeats are fine.
    """
    stars = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        seen = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for done in (stars, low, large, least):
            discard(done)
        stars = following
        if seen == state:
            out = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._gridloom_path = stars._gridloom_path
            return out
        state = seen
