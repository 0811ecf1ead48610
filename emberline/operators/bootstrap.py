"""Cluster bootstrap in one pass: each replicate's totals are added up where the clusters lie, in place of a row for each replicate and cluster.

Clusters are dealt by ranges of their key. A replicate draws as many clusters as there are, with replacement: how many of its draws fall into each range, and within a range into each stretch of
clusters and each cluster, is drawn from multinomial distributions by generators that (seed, replicate) and (seed, range) name. So a task holds the totals of all replicates and no more, and a range sends on
one row for each replicate, however many clusters it has.

Results in special cases: null totals or weights count as 0; a replicate whose weights add up to 0 has a NaN; an empty table gives no row. The replicates depend on how the ranges are cut, so on
spark.sql.shuffle.partitions and the sample that cuts them; the interval does within Monte-Carlo error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.tables import kept_table

#: Clusters whose draws are held at a time: with 2,000 replicates 8 MB.
STRETCH = 512


class Range:
    """The replicates' totals over the clusters of one range, which come one stretch after the other."""

    def __init__(self, of: int, sizes: list[int], n_boot: int, seed: int):
        share = np.array(sizes) / sum(sizes)
        self.left = np.array([np.random.default_rng([seed, b]).multinomial(sum(sizes), share)[of] for b in range(n_boot)])
        self.clusters, self.rng = sizes[of], np.random.default_rng([seed, n_boot, of])
        self.sums = np.zeros((2, n_boot))

    def add(self, values: np.ndarray) -> None:
        """values: totals and weights of the next clusters, a row each."""
        for at in range(0, values.shape[1], STRETCH):
            part = values[:, at : at + STRETCH]
            n = part.shape[1]
            own = self.rng.binomial(self.left, min(1.0, n / self.clusters))
            self.left, self.clusters = self.left - own, self.clusters - n
            self.sums += part @ self.rng.multinomial(own, np.full(n, 1 / n)).T


def replicates(clusters: DataFrame, key: str, total: str, weight: str, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """(replicate int, total, weight double); clusters has one row for each key."""
    spark = clusters.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    own = clusters.select(F.col(key).alias("key"), value(total).alias("total"), value(weight).alias("weight"))
    dealt = kept_table(own.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()))
    # one row for each range
    counted = {r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()}
    names = sorted(counted)
    sizes = [counted[r] for r in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Range] = {}
        for batch in batches:
            at, rows = batch.column(0).to_numpy(), np.stack([batch.column(k).to_numpy() for k in (1, 2)])
            for r in np.unique(at).tolist():
                held.setdefault(r, Range(names.index(r), sizes, n_boot, seed)).add(rows[:, at == r])
        for found in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(range(n_boot), pa.int32()), *(pa.array(x) for x in found.sums)], names=["replicate", "total", "weight"])

    rows = dealt.select("range", "total", "weight", "key").repartition(ranges, "range").sortWithinPartitions("range", "key").drop("key")
    return rows.mapInArrow(run, "replicate int, total double, weight double").groupBy("replicate").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))


def interval(clusters: DataFrame, key: str, total: str, weight: str, n_boot: int = 2000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float, float] | None:
    """(point, low, high) of the ratio of totals to weights. What reaches the driver is one number for each replicate."""
    found = replicates(clusters, key, total, weight, n_boot, seed).select((F.col("total") / F.when(F.col("weight") != 0, F.col("weight"))).alias("v")).collect()
    if not found:
        return None
    values = np.sort([np.nan if r["v"] is None else r["v"] for r in found])
    point = clusters.agg(F.try_divide(F.sum(total), F.sum(weight))).first()[0]
    return point, float(values[int(alpha / 2 * n_boot)]), float(values[int((1 - alpha / 2) * n_boot) - 1])
