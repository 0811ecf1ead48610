"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a min per node and a join back; rounds are written to the shared folder, so lineage stays short and
nothing is collected. Hubs are split by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), nulls and loops allowed -> (node long, component long): every node that has an edge, with the smallest node it reaches."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        # large-star: the larger neighbours of each node move to the smallest of its neighbours and itself
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct())
        # small-star: the smaller neighbours of each node, and the node, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        last, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
    stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
