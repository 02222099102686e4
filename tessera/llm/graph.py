"""Connected components by alternating star contraction on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_skewed, saved


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (u, v), root the smallest node of its component; roots themselves are left out.

    Each round points the larger neighbours of a node at its smallest one (large star), then the smaller ones (small
    star). The edges are a saved table between rounds; a few numbers come to the driver. The centre of a large group has
    many edges: they meet its row of the large star by join_skewed(), and in no other step are edges dealt out by centre.
    """
    now = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(now)
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        least = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        centres = now.groupBy("v").agg(F.count("*").alias("n")).join(least, "v", "left")
        met = join_skewed(now, saved(centres), ["v"], "n", ["m"], F.xxhash64("u"))
        large = met.select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, large.u == least.w).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = saved(small.select("e.*").filter("u <> v").distinct())
        last, seen = seen, mark(now)
        if seen == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
