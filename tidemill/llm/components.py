"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 50) -> DataFrame:
    """(id, label) for every id in links (a, b): label is the smallest id reachable, for ids other than it.

    Each step points every node's neighbours at the least node it knows. Minima are aggregated before
    the shuffle and written, so a hub's edges meet them in a join that Spark can split.
    """
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{name}-0")
    state = None
    for i in range(1, rounds + 1):
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-{i}-large")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.save(large, f"{name}-{i}-a")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{i}-small")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.save(small, f"{name}-{i}-b")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
