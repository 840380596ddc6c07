"""Key sources by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keysift.sources.keyfiles import scan_key_files, small_tables

KeySource = Callable[[SparkSession, str], DataFrame]

SOURCES: dict[str, KeySource] = {}


def register_source(name: str, read: KeySource) -> None:
    SOURCES[name] = read


def read_keys(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Key tables (table_id, pos, key) of a registered source."""
    if source not in SOURCES:
        raise ValueError(f"unknown key source {source!r}; known: {sorted(SOURCES)}")
    return SOURCES[source](spark, path)


register_source("vdisk", scan_key_files)
register_source("vdisk_small", lambda spark, path: small_tables(scan_key_files(spark, path)))
register_source("parquet", lambda spark, path: spark.read.parquet(path).select("table_id", "pos", "key"))
