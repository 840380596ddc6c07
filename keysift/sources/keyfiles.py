"""Reading and writing key tables and small text reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.operators.ordering import grouped_row_number
from keysift.session import broadcast_if_small


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a sort key for file order: (path, block, arrival, value)."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("arrival"),
        "value",
    )


def file_ranks(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a glob with its rank by path; an empty file takes a rank too.

    The names are the listing Spark keeps on the driver for any scan of the folder; the content of
    the files does not pass through it.
    """
    names = sorted(_PLAIN.sub("/", name) for name in spark.read.text(path).inputFiles())
    return spark.createDataFrame([(name, rank) for rank, name in enumerate(names)], "path string, table_id int")


_PLAIN = re.compile("^file:/+")


def _plain_path(column):
    return F.regexp_replace(column, _PLAIN.pattern, "/")


def scan_key_files(spark: SparkSession, path: str, trim: bool = True) -> DataFrame:
    """One key table per file: (table_id, pos, key)."""
    ranks = file_ranks(spark, path)
    lines = text_lines(spark, path).withColumn("path", _plain_path(F.col("path")))
    joined = lines.join(broadcast_if_small(ranks), "path")
    numbered = grouped_row_number(joined.drop("path"), ["table_id"], ["block", "arrival"], "pos")
    key = F.regexp_replace("value", r"\s+$", "") if trim else F.col("value")
    return numbered.select("table_id", "pos", key.alias("key"))


def small_tables(keys: DataFrame, limit: int = 1000) -> DataFrame:
    """Drop tables with more than ``limit`` keys and rank the others anew."""
    sizes = keys.groupBy("table_id").agg(F.count("*").alias("_n")).where(F.col("_n") <= limit)
    ranked = grouped_row_number(sizes.select("table_id"), [], ["table_id"], "rank")
    joined = keys.join(broadcast_if_small(ranked), "table_id").drop("table_id")
    return joined.withColumn("table_id", F.col("rank").cast("int")).drop("rank")


def read_ratio_report(spark: SparkSession, path: str) -> DataFrame:
    """``path ratio`` lines with their 1-based line number."""
    lines = grouped_row_number(text_lines(spark, path), [], ["path", "block", "arrival"], "_line")
    parts = F.split("value", " ")
    return lines.select(
        (F.col("_line") + 1).alias("line"), F.get(parts, F.lit(0)).alias("name"),
        F.get(parts, F.lit(1)).try_cast("double").alias("ratio"),
    )


def write_lines(df: DataFrame, path: str, order: list[str], value: str = "value") -> None:
    """Write text lines so that the part files, by name, hold them in order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(value).write.text(path)
