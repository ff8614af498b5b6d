"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot


def _large_star(edges: DataFrame) -> DataFrame:
    """Each end meets the smallest node next to its smaller one; a hub's many edges are salted (`join_hot`)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n")))
    return join_hot(both.where("b > a"), low, ["a"], "b", 2 * edges.count()).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """`edges` point from the larger to the smaller end; each end then meets the smallest end of its larger one."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    met = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a long, b long) but the roots; root is the smallest node reachable.

    The edges stay distributed; each round is checkpointed in the shared folder, and only whether
    the edges are stars already comes to the driver. Self-links and repeated links are allowed; no edges give no rows.
    """
    # a round reads its input many times: cut what the caller hands over, so that nothing behind it runs again
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        now = cut(_small_star(_large_star(now)))
        ends = now.select("a", F.lit(1).alias("one")).union(now.select("b", F.lit(0)).distinct())
        # a forest of stars: each node once, as a leaf or as a root
        if ends.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
