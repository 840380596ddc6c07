"""Exact membership and key overlap between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_text(x: Column) -> Column:
    """A numeric row as text: its single-precision values joined by a colon."""
    return F.array_join(F.transform(x, lambda v: v.cast("float").cast("string")), ":")


def exact_members(probes: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Add ``prediction`` (1 or -1): whether the probe's row was seen in the table it asks."""
    seen = rows.select(*on).distinct().withColumn("_seen", F.lit(1))
    return probes.join(seen, on, "left").withColumn("prediction", F.coalesce(F.col("_seen"), F.lit(-1))).drop("_seen")


def table_sets(keys: DataFrame) -> DataFrame:
    """For each distinct key, the tables that hold it and its rows there (one entry per table)."""
    counted = keys.groupBy("key", "table_id").agg(F.count("*").alias("n"))
    return counted.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("table_id", "n"))).alias("held"))


def shared_keys(keys: DataFrame) -> DataFrame:
    """For each ordered pair of tables, the rows of the first whose key the second holds too.

    Keys with the same set of tables are added up first, so pairs are formed per distinct set of
    tables and never per key or per row.
    """
    shared = table_sets(keys).where(F.size("held") > 1)
    signature = F.col("held.table_id").alias("tables")
    sums = (
        shared.select(signature, F.explode("held").alias("h"))
        .groupBy("tables", F.col("h.table_id").alias("table_a"))
        .agg(F.sum("h.n").alias("n"))
    )
    pairs = sums.select("table_a", F.explode("tables").alias("table_b"), "n").where("table_a <> table_b")
    return pairs.groupBy("table_a", "table_b").agg(F.sum("n").alias("shared_rows"))


def shared_summary(keys: DataFrame) -> DataFrame:
    """Half of all ordered shared rows, and that number as a percentage of all keys."""
    total = shared_keys(keys).agg(F.coalesce(F.sum("shared_rows"), F.lit(0)).alias("ordered"))
    half = F.col("ordered") / 2
    rows = keys.agg(F.count("*")).scalar()
    return total.select(half.alias("shared"), (half * 100 / rows).alias("shared_percent"))


def duplicate_rate(keys: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct("key") if approximate else F.count_distinct("key")
    counted = keys.agg(F.count("*").alias("total_keys"), distinct.alias("distinct_keys"))
    return counted.withColumn(
        "duplicate_percent", (F.col("total_keys") - F.col("distinct_keys")) * 100 / F.col("total_keys")
    )
