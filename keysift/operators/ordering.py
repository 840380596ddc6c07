"""Row numbers and equal splits inside groups of any size.

A window over ``partitionBy(group)`` sends a whole group to one task.  Here the rows are range
partitioned on (group, order), so a group that holds a third of the table spreads over as many
tasks as its size deserves, and only one row per (group, partition) is ranked by a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.session import materialize, settled

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above 33 bits of row index


def grouped_row_number(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "pos", with_size: str | None = None
) -> DataFrame:
    """Add the 0-based rank of each row inside its group, and the group's size if asked for."""
    group = list(group)
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    # The arrival number splits runs of equal sort keys over several partitions.
    ordered = df.withColumn("_tie", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(*keys, F.col("_tie")).sortWithinPartitions(*keys, F.col("_tie")).drop("_tie")
    ordered = materialize(ordered.withColumn("_row", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_chunk", F.shiftright("_row", _ROW_BITS))

    chunks = ordered.groupBy(*group, "_chunk").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    if with_size:
        offsets = offsets.withColumn(with_size, F.sum("_n").over(Window.partitionBy(*group)))
    offsets = settled(offsets.drop("_first", "_n"))
    joined = ordered.join(offsets, [*group, "_chunk"])  # one offset per (group, partition)
    return joined.withColumn(name, F.col("_row") + F.col("_offset")).drop("_row", "_chunk", "_offset")


def grouped_ntile(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], buckets: int, name: str
) -> DataFrame:
    """Deal each group, in order, into ``buckets`` runs whose sizes differ by at most one (0-based)."""
    ranked = grouped_row_number(df, group, order, "_pos", with_size="_size")
    base, extra = F.expr(f"_size div {buckets}"), F.expr(f"_size % {buckets}")
    edge = extra * (base + 1)
    tile = F.when(F.col("_pos") < edge, F.expr(f"_pos div (_size div {buckets} + 1)")).otherwise(
        extra + F.floor((F.col("_pos") - edge) / F.greatest(base, F.lit(1)))
    )
    return ranked.withColumn(name, tile.cast("int")).drop("_pos", "_size")


def grouped_order_statistics(
    df: DataFrame, group: Sequence[str], value: str, fraction: float, name: str, buckets: int = 4096
) -> DataFrame:
    """Exact lower quantile per group: the value at rank ``floor(fraction * (n - 1))``.

    Equal-width buckets are counted first (map-side combine); only the rows of the one bucket per
    group that holds the wanted rank are put in order.
    """
    group = list(group)
    ranges = df.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    ranges = settled(ranges)
    share = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    bucket = F.least(F.coalesce(F.floor(share * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")
    located = df.select(*group, value).join(ranges, group).withColumn("_bucket", bucket)
    counts = located.groupBy(*group, "_bucket").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    target = F.floor(F.lit(fraction) * (F.col("_n") - 1))
    chosen = counts.where((target >= F.col("_before")) & (target < F.col("_before") + F.col("_c")))
    chosen = settled(chosen.select(*group, "_bucket", (target - F.col("_before")).alias("_at")))
    inside = located.select(*group, value, "_bucket").join(chosen, [*group, "_bucket"])
    ranked = grouped_row_number(inside.select(*group, value, "_at"), group, [value], "_pos")
    return ranked.where(F.col("_pos") == F.col("_at")).select(*group, F.col(value).alias(name))
