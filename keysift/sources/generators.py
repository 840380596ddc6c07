"""Synthetic clusters around given centres, and dealing whole clusters to tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.operators.ordering import grouped_ntile


def normal(row_id: Column, seed: int, salt: int = 0) -> Column:
    """A standard normal draw that follows from the row's id, whatever the partitioning or a repeated task."""
    unit = lambda s: (F.pmod(F.xxhash64(row_id, F.lit(seed), F.lit(salt), F.lit(s)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * math.pi * unit(2))


def with_gauss(rows: DataFrame, cluster: str, gap: float, sigma: float, seed: int = 42, row_id: str = "id") -> DataFrame:
    """One normal draw per row, around ``gap`` times its cluster number; ``row_id`` tells rows apart."""
    return rows.withColumn("value", normal(F.col(row_id), seed) * sigma + F.col(cluster) * gap)


def with_gauss_2d(
    rows: DataFrame, cluster: str, gap: float, covariance: tuple[tuple[float, float], tuple[float, float]], seed: int = 42, row_id: str = "id"
) -> DataFrame:
    """One correlated 2-D draw per row, around ``(gap, gap)`` times its cluster number."""
    (a, b), (_, d) = covariance
    l11 = math.sqrt(a)
    l21 = b / l11
    l22 = math.sqrt(d - l21 * l21)
    drawn = rows.withColumn("_u", normal(F.col(row_id), seed, 1)).withColumn("_v", normal(F.col(row_id), seed, 2))
    centre = F.col(cluster) * gap
    return (
        drawn.withColumn("x", centre + F.col("_u") * l11)
        .withColumn("y", centre + F.col("_u") * l21 + F.col("_v") * l22)
        .drop("_u", "_v")
    )


def gauss_clusters(spark: SparkSession, clusters: int, gap: float, sigma: float, size: int, seed: int = 42) -> DataFrame:
    """``clusters`` groups of ``size`` draws each."""
    rows = spark.range(clusters * size).select("id", (F.col("id") % clusters).alias("cluster"))
    return with_gauss(rows, "cluster", gap, sigma, seed).drop("id")


def shuffle_key(column: Column, seed: int) -> Column:
    """A reproducible shuffle order that any engine with md5 can repeat."""
    return F.md5(F.concat_ws(":", column.cast("string"), F.lit(str(seed))))


def deal_clusters(clusters: DataFrame, cluster: str, tables: int, seed: int = 42) -> DataFrame:
    """Whole clusters to tables, in shuffled order and equal numbers."""
    return grouped_ntile(clusters.select(cluster).distinct(), [], [shuffle_key(F.col(cluster), seed)], tables, "table_id")
