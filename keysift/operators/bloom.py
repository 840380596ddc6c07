"""Sliced Bloom filters, one per group of keys, as DataFrames.

A filter set is two tables: ``params`` (one row per filter) and ``words`` (one row per 64 filter
bits).  Building is one aggregation with map-side combine; union, intersection and appending are
``bit_or`` / ``bit_and`` over words; probing brings packed filters to the rows that ask them, in
groups that fit a broadcast, and joins words only for filters that are too large one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.functions import hashing
from keysift.functions.hashing import MEDIUM_LIMIT, NARROW_LIMIT, HashScheme
from keysift.session import BROADCAST_BYTES, BROADCAST_ROWS, beside, broadcast_if_small, materialize, same_address

WORD_BITS = 64
PARAM_COLUMNS = ["error_rate", "num_slices", "bits_per_slice", "num_bits", "capacity"]


def check_error_rate(error_rate: float) -> None:
    if not 0 < error_rate < 1:
        raise ValueError("error_rate must be between 0 and 1")


def slices_for(error_rate: float) -> int:
    check_error_rate(error_rate)
    return math.ceil(math.log(1.0 / error_rate, 2))


def with_filter_size(df: DataFrame, capacity: Column, error_rate: Column) -> DataFrame:
    """Add the filter dimensions for a capacity and an error rate held in columns."""
    guard = F.when(~((error_rate > 0) & (error_rate < 1)), F.raise_error(F.lit("error_rate must be between 0 and 1")))
    guard = guard.when(~(capacity > 0), F.raise_error(F.lit("capacity must be positive"))).otherwise(error_rate)
    slices = F.ceil(F.log2(1.0 / F.col("error_rate")))
    per_slice = F.ceil(F.col("capacity") * F.abs(F.log(F.col("error_rate"))) / (F.col("num_slices") * math.log(2) ** 2))
    return (
        df.withColumn("capacity", capacity)
        .withColumn("error_rate", guard.cast("double"))
        .withColumn("num_slices", slices.cast("int"))
        .withColumn("bits_per_slice", per_slice.cast("bigint"))
        .withColumn("num_bits", F.col("num_slices") * F.col("bits_per_slice"))
    )


# Slice widths in bits that use words of 2, 4 and 8 bytes.
WIDTH_SPANS = {2: (0, NARROW_LIMIT), 4: (NARROW_LIMIT, MEDIUM_LIMIT), 8: (MEDIUM_LIMIT, (1 << 63) - 1)}


def measure(params: DataFrame) -> dict:
    row = params.agg(
        F.sum("num_bits").alias("bits"), F.min("bits_per_slice").alias("lo"), F.max("bits_per_slice").alias("hi"), F.count("*").alias("n")
    ).first()
    return {"bytes": (row["bits"] or 0) / 8, "lo": row["lo"] or 1, "hi": row["hi"] or 1, "filters": row["n"]}


def used_widths(facts: dict) -> list[int]:
    return [w for w, (lo, hi) in WIDTH_SPANS.items() if facts["lo"] < hi and facts["hi"] >= lo]


@dataclass
class FilterSet:
    """Filters that share one error rate, addressed by the columns in ``by``."""

    by: list[str]
    error_rate: float
    params: DataFrame
    words: DataFrame
    _facts: dict = field(default_factory=dict)

    @property
    def num_slices(self) -> int:
        return slices_for(self.error_rate)

    def facts(self) -> dict:
        """Measured size of the set: total bytes and the narrowest and widest slice."""
        if not self._facts:
            self._facts.update(measure(self.params))
        return self._facts

    def widths(self) -> list[int]:
        return used_widths(self.facts())

    def packed(self) -> DataFrame:
        """One row per filter with all its words in order; only for sets measured to be small."""
        last = F.floor((F.col("num_bits") - 1) / WORD_BITS).cast("bigint")
        blank = self.params.select(
            *self.by, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("word"), F.lit(0).cast("bigint").alias("bits")
        )
        dense = blank.unionByName(self.words.select(*self.by, "word", "bits")).groupBy(*self.by, "word").agg(F.bit_or("bits").alias("bits"))
        rows = dense.groupBy(*self.by).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("_w"))
        return self.params.join(rows, self.by).select(*self.by, "bits_per_slice", F.col("_w.bits").alias("_packed"))


def size_filters(capacities: DataFrame, by: Sequence[str], error_rate: float, capacity: str = "capacity") -> DataFrame:
    """Filter parameters per group; a capacity below one counts as one.

    The result (one row per filter) is checkpointed: it is asked for its size and joined again.
    """
    check_error_rate(error_rate)
    sized = with_filter_size(capacities, F.greatest(F.col(capacity), F.lit(1)), F.lit(float(error_rate)))
    return materialize(sized.select(*by, *PARAM_COLUMNS))


def key_bits(keys: DataFrame, params: DataFrame, by: Sequence[str], error_rate: float, key: str = "key") -> DataFrame:
    """Every (key row, slice) with the absolute bit it sets in its own filter."""
    by, facts = list(by), measure(params)
    sizes = params.select(*by, "bits_per_slice")
    joined = keys.join(F.broadcast(sizes) if facts["filters"] <= BROADCAST_ROWS else sizes, by)
    words, size, widths = None, F.col("bits_per_slice"), used_widths(facts)
    for width in widths:
        low, high = WIDTH_SPANS[width]
        fits = None if len(widths) == 1 else (size >= low) & (size < high)
        joined, found = hashing.with_digests(joined, key, HashScheme(slices_for(error_rate), width), f"_d{width}", fits)
        found = found.cast("array<decimal(20,0)>" if 8 in widths else "array<bigint>")
        words = found if words is None else F.when(fits, found).otherwise(words)
    # The words stay an expression of the generator: a plain column would be filtered on, and hashed again.
    exploded = joined.select(*keys.columns, "bits_per_slice", F.posexplode(words).alias("slice", "_word"))
    exploded = exploded.withColumn("position", (F.col("_word") % size).cast("bigint")).drop("_word")
    return exploded.withColumn("bit", F.col("slice") * size + F.col("position")).drop("bits_per_slice")


def bits_to_words(bits: DataFrame, by: Sequence[str]) -> DataFrame:
    flagged = bits.select(
        *by, F.expr(f"bit div {WORD_BITS}").alias("word"), F.expr(f"shiftleft(1L, cast(bit % {WORD_BITS} as int))").alias("_m")
    )
    return flagged.groupBy(*by, "word").agg(F.bit_or("_m").alias("bits"))


def words_to_bits(words: DataFrame, by: Sequence[str]) -> DataFrame:
    """Unpack to one row per set bit."""
    spread = words.select(*by, "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(WORD_BITS - 1))).alias("_o"))
    return spread.where("bit_get(bits, _o) = 1").select(*by, (F.col("word") * WORD_BITS + F.col("_o")).alias("bit"))


def build_filters(
    keys: DataFrame, params: DataFrame, by: Sequence[str], error_rate: float, key: str = "key"
) -> FilterSet:
    """Build all filters in one aggregation; duplicates collapse in the map-side combine."""
    bits = key_bits(keys.select(*by, key), params, by, error_rate, key)
    return FilterSet(list(by), error_rate, params, bits_to_words(bits, by))


def plain_filters(keys: DataFrame, by: Sequence[str], error_rate: float, key: str = "key") -> FilterSet:
    """Filters over all keys of each group, with the number of keys as capacity."""
    counts = keys.groupBy(*by).agg(F.count("*").alias("capacity"))
    return build_filters(keys, size_filters(counts, by, error_rate), by, error_rate, key)


def insert_counts(
    keys: DataFrame, params: DataFrame, by: Sequence[str], error_rate: float, key: str = "key", pos: str = "pos",
    skip_check: bool = False,
) -> DataFrame:
    """Keys that set at least one new bit when inserted in row order, or every key with ``skip_check``."""
    by = list(by)
    if skip_check:
        counts = keys.groupBy(*by).agg(F.count("*").alias("count"))
    else:
        bits = key_bits(keys.select(*by, key, pos), params, by, error_rate, key)
        setters = bits.groupBy(*by, "bit").agg(F.min(pos).alias("_p")).select(*by, "_p").distinct()
        counts = setters.groupBy(*by).agg(F.count("*").alias("count"))
    joined = params.select(*by, "capacity").join(counts, by, "left")
    count = F.coalesce(F.col("count"), F.lit(0)).cast("bigint")
    return joined.select(*by, "capacity", count.alias("count"), (count > F.col("capacity")).alias("over_capacity"))


# --- probing ---------------------------------------------------------------------------------


def with_digests(probes: DataFrame, filters: FilterSet, key: str = "key") -> DataFrame:
    """Hash every probe once, in the word widths this set needs, before it meets any filter."""
    for width in filters.widths():
        columns = probes.columns
        hashed, words = hashing.with_digests(probes, key, HashScheme(filters.num_slices, width), f"_d{width}")
        probes = hashed.select(*columns, words.alias(f"_d{width}"))
    return probes


def _slice_bit(filters: FilterSet, i: int) -> Column:
    """Absolute bit of slice ``i``, from the digest columns and ``bits_per_slice``."""
    size = F.col("bits_per_slice")
    spot = {w: (F.get(F.col(f"_d{w}"), F.lit(i)) % size).cast("bigint") for w in filters.widths()}
    limits = {2: size < NARROW_LIMIT, 4: size < MEDIUM_LIMIT, 8: F.lit(True)}
    chosen = None
    for width, value in spot.items():
        if len(spot) == 1:
            chosen = value
        else:
            chosen = F.when(limits[width], value) if chosen is None else chosen.when(limits[width], value)
    return F.lit(i).cast("bigint") * size + chosen


def fits_broadcast(filters: FilterSet, limit: int | None = None) -> bool:
    return filters.facts()["bytes"] <= (BROADCAST_BYTES if limit is None else limit)


def packed_hit(filters: FilterSet) -> Column:
    """All slices set, tested against a joined ``_packed`` column; stops at the first clear bit."""
    test = F.lit(True)
    for i in range(filters.num_slices):
        bit = _slice_bit(filters, i)
        word = F.get(F.col("_packed"), F.shiftright(bit, 6).cast("int"))
        test = test & (F.bit_get(word, (bit % WORD_BITS).cast("int")) == 1)
    return test


def _without_digests(rows: DataFrame, filters: FilterSet) -> list[str]:
    return [c for c in rows.columns if c not in {f"_d{w}" for w in filters.widths()}]


def _ask_packed(pairs: DataFrame, filters: FilterSet) -> DataFrame:
    packed, met = beside(filters.packed(), filters.by)
    joined = pairs.join(F.broadcast(packed), same_address(filters.by), "left")
    return joined.select(*_without_digests(pairs, filters), F.coalesce(packed_hit(filters) & met, F.lit(False)).alias("_maybe"))


def _ask_slices(pairs: DataFrame, filters: FilterSet) -> DataFrame:
    """Slice by slice through joins, for filters that are too large one by one; rows that fail a slice travel no further."""
    columns = _without_digests(pairs, filters)
    alive = pairs.join(broadcast_if_small(filters.params.select(*filters.by, "bits_per_slice")), filters.by, "left")
    done = None
    for i in range(filters.num_slices):
        asked = alive.withColumn("_bit", _slice_bit(filters, i)).withColumn("word", F.expr(f"_bit div {WORD_BITS}"))
        asked = asked.join(filters.words, [*filters.by, "word"], "left")
        hit = F.coalesce(F.expr(f"bit_get(bits, cast(_bit % {WORD_BITS} as int)) = 1"), F.lit(False))
        asked = materialize(asked.withColumn("_maybe", hit).drop("word", "bits", "_bit"))
        failed = asked.where("not _maybe").select(*columns, "_maybe")
        done = failed if done is None else done.unionByName(failed)
        alive = asked.where("_maybe").drop("_maybe")
    return done.unionByName(alive.select(*columns, F.lit(True).alias("_maybe")))


def asked_parts(pairs: DataFrame, filters: FilterSet) -> Iterator[DataFrame]:
    """All rows of ``pairs`` with ``_maybe``, in parts that each need filters of a bounded size on the executors.

    ``pairs`` holds the ``by`` columns of the filter to ask and the digests of its key (``with_digests``).  Rows are
    never shuffled: filters are dealt into groups that fit a broadcast and brought to the rows, one group
    a part.  Only rows that ask a filter which is too large by itself are joined to its words.
    """
    if fits_broadcast(filters):
        yield _ask_packed(pairs, filters)
        return
    sized = filters.params.select(*filters.by, (F.col("num_bits") / 8).alias("_bytes"))
    large = F.broadcast(sized.where(F.col("_bytes") > BROADCAST_BYTES).select(*filters.by))
    rest = sized.join(large, filters.by, "left_anti")
    dealt, groups = F.xxhash64(*filters.by), 1
    while True:
        most = rest.groupBy(F.pmod(dealt, F.lit(groups)).alias("g")).agg(F.sum("_bytes").alias("b")).agg(F.max("b")).first()[0] or 0
        if most <= BROADCAST_BYTES or groups >= 1 << 20:
            break
        groups *= 2
    for g in range(groups):
        here = F.pmod(dealt, F.lit(groups)) == g
        own = [df.where(here).join(large, filters.by, "left_anti") for df in (filters.params, filters.words, pairs)]
        yield _ask_packed(own[2], FilterSet(filters.by, filters.error_rate, own[0], own[1], filters.facts()))
    own = [df.join(large, filters.by, "left_semi") for df in (filters.params, filters.words, pairs)]
    yield _ask_slices(own[2], FilterSet(filters.by, filters.error_rate, own[0], own[1], filters.facts()))


def answered(pairs: DataFrame, filters: FilterSet) -> DataFrame:
    """All rows of ``pairs`` with ``_maybe``; see ``asked_parts``."""
    return reduce(DataFrame.unionByName, asked_parts(pairs, filters))


def probe_hits(pairs: DataFrame, filters: FilterSet) -> DataFrame:
    """The (probe, filter) rows whose filter answers "maybe"."""
    return answered(pairs, filters).where("_maybe").drop("_maybe")


# --- algebra and statistics ------------------------------------------------------------------


def check_compatible(left: FilterSet, right: FilterSet) -> None:
    """Both sets must hold the same filters with the same capacity and error rate."""
    if left.error_rate != right.error_rate:
        raise ValueError("filters need the same error rate")
    mine, theirs = left.params.select(*left.by, "capacity"), right.params.select(*left.by, "capacity")
    if not mine.exceptAll(theirs).isEmpty() or not theirs.exceptAll(mine).isEmpty():
        raise ValueError("filters need the same capacity")


def union_filters(left: FilterSet, right: FilterSet) -> FilterSet:
    check_compatible(left, right)
    both = left.words.unionByName(right.words)
    words = both.groupBy(*left.by, "word").agg(F.bit_or("bits").alias("bits"))
    return FilterSet(left.by, left.error_rate, left.params, words)


def intersect_filters(left: FilterSet, right: FilterSet) -> FilterSet:
    check_compatible(left, right)
    joined = left.words.join(right.words.withColumnRenamed("bits", "_other"), [*left.by, "word"])
    words = joined.withColumn("bits", F.col("bits").bitwiseAND(F.col("_other"))).drop("_other")
    return FilterSet(left.by, left.error_rate, left.params, words.where("bits <> 0"))


def append_keys(filters: FilterSet, keys: DataFrame, key: str = "key") -> FilterSet:
    """Set the bits of further keys; the sizes stay as they are."""
    fresh = build_filters(keys, filters.params, filters.by, filters.error_rate, key)
    words = filters.words.unionByName(fresh.words).groupBy(*filters.by, "word").agg(F.bit_or("bits").alias("bits"))
    return FilterSet(filters.by, filters.error_rate, filters.params, words)


def fill_statistics(filters: FilterSet) -> DataFrame:
    """Set and clear bits per filter, and the share of set bits."""
    ones = filters.words.groupBy(*filters.by).agg(F.sum(F.bit_count("bits")).cast("bigint").alias("ones"))
    joined = filters.params.join(ones, filters.by, "left").fillna(0, ["ones"])
    return joined.select(
        *filters.by, "num_slices", "bits_per_slice", "ones",
        (F.col("num_bits") - F.col("ones")).alias("zeros"),
        (F.col("ones") / F.col("num_bits")).alias("fill"),
    )


def projected_fp_rate(keys: Column, num_slices: Column, num_bits: Column) -> Column:
    return F.pow(1 - F.exp(-num_slices * (keys + 0.5) / (num_bits - 1)), num_slices)


def total_filter_bytes(params: DataFrame) -> DataFrame:
    return params.agg((F.sum("num_bits") / 8).alias("filter_bytes"))


# --- persistence -----------------------------------------------------------------------------


def save_filters(filters: FilterSet, path: str) -> None:
    """Header table and 64-bit words as Parquet."""
    filters.params.write.mode("overwrite").parquet(f"{path}/header")
    filters.words.select(*filters.by, "word", "bits").write.mode("overwrite").parquet(f"{path}/words")


def load_filters(spark, path: str, by: Sequence[str]) -> FilterSet:
    """Read a saved set back; a bit beyond its header's length raises, also inside the last word."""
    by = list(by)
    params = spark.read.parquet(f"{path}/header")
    rate = params.select("error_rate").first()[0]
    checked = spark.read.parquet(f"{path}/words").join(broadcast_if_small(params.select(*by, "num_bits")), by)
    room = F.col("num_bits") - F.col("word") * WORD_BITS
    stray = F.when(room >= WORD_BITS, False).when(room <= 0, True).otherwise(F.expr(f"shiftrightunsigned(bits, cast(num_bits - word * {WORD_BITS} as int)) <> 0"))
    guard = F.when(stray, F.raise_error(F.lit("bit length does not match the header"))).otherwise(F.col("bits"))
    return FilterSet(by, rate, params, checked.select(*by, "word", guard.cast("bigint").alias("bits")))
