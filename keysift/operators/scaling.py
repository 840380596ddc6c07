"""Per-table scalers, column profiles and histograms over rows with a feature array ``x``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.session import broadcast_if_small, materialize, settled


def long_form(rows: DataFrame, by: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, dimension)."""
    # An expression, not the column: exploding a column adds a filter on it that computes ``x`` twice.
    whole = F.concat("x", F.array().cast("array<double>"))
    return rows.select(*by, *keep, F.posexplode(whole).alias("dim", "value"))


def fit_standard(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per (table, dimension); a zero deviation counts as one."""
    spread = F.stddev_pop("value")
    fitted = long_form(rows, by).groupBy(*by, "dim").agg(F.avg("value").alias("shift"), spread.alias("scale"))
    return materialize(fitted.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))))


def fit_minmax(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Minimum and range per (table, dimension); a zero range counts as one."""
    low, high = F.min("value"), F.max("value")
    fitted = long_form(rows, by).groupBy(*by, "dim").agg(low.alias("shift"), (high - low).alias("scale"))
    return materialize(fitted.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))))


def scaler_arrays(scalers: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per scaler: its shifts and scales in dimension order."""
    packed = scalers.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("dim", "shift", "scale"))).alias("_s"))
    return packed.select(*by, F.col("_s.shift").alias("_shift"), F.col("_s.scale").alias("_scale"))


def apply_scaler(rows: DataFrame, scalers: DataFrame, by: Sequence[str], scaler_by: Sequence[str] | None = None) -> DataFrame:
    """Scale ``x``; ``scaler_by`` names the row's columns that pick the scaler (its own by default)."""
    packed = scaler_arrays(scalers, by)
    for mine, theirs in zip(by, scaler_by or by):
        packed = packed.withColumnRenamed(mine, theirs)
    joined = rows.join(broadcast_if_small(packed), list(scaler_by or by))
    centred = F.zip_with("x", "_shift", lambda v, m: v - m)
    return joined.withColumn("x", F.zip_with(centred, "_scale", lambda v, s: v / s)).drop("_shift", "_scale")


def column_profile(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return long_form(rows, by).groupBy(*by, "dim").agg(
        F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.stddev_pop("value").alias("deviation"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )


def histogram(rows: DataFrame, by: Sequence[str], value: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed; empty bins included."""
    by = list(by)
    ranges = rows.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("rows"))
    ranges = ranges.withColumn("width", (F.col("high") - F.col("low")) / bins)
    ranges = settled(ranges)
    located = rows.join(ranges, by)
    spot = F.floor(F.try_divide(F.col(value) - F.col("low"), F.col("width")))
    bin_ = F.least(F.coalesce(spot, F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = located.withColumn("bin", bin_).groupBy(*by, "bin").agg(F.count("*").alias("count"))
    every = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    joined = every.join(counted, [*by, "bin"], "left").fillna(0, ["count"])
    density = F.try_divide(F.col("count"), F.col("rows") * F.col("width"))
    return joined.select(*by, "bin", "count", (F.col("low") + F.col("bin") * F.col("width")).alias("edge"), density.alias("density"))
