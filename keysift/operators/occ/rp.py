"""Random-projection one-class model: dense intervals on random directions.

Each table's rows are projected on the same unit directions; a direction accepts a row whose
projection lies in one of the table's intervals.  Interval fitting needs no sort: two projections
closer than half the gap width share a cell, so cells are aggregated first (map-side combine) and
only the at most ``2/epsilon + 1`` cells of a (table, direction) are put in order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysift.session import BROADCAST_BYTES, beside, broadcast_if_small, materialize, same_address, settled

PACKED_DIMS = 32  # more directions than this are scored through joins
# Directions of one broadcast join.  The generated code of six of them is a method of over 9000 bytes; the JVM compiles
# none of more than 8000, and took some 30 microseconds a row.
JOINED_DIMS = 2
PLANE_SEED = 42  # fixed value: the seed of the directions
WIDENING = float(np.finfo(np.float32).eps)  # fixed value: how far open intervals are widened


@dataclass(frozen=True)
class RPParams:
    """``closed`` keeps intervals at the threshold, does not widen them and includes their ends."""

    D: int = 9
    epsilon: float = 1e-2
    agg_thr: float = 0.9
    box_thr: float = 1e-2
    agg_abs: int | None = None
    closed: bool = False


def unit_planes(dims: int, features: int) -> np.ndarray:
    planes = np.random.RandomState(seed=PLANE_SEED).uniform(low=-1, size=(dims, features))
    return planes / np.sqrt((planes * planes).sum(axis=-1)).reshape(-1, 1)


def project(x: Column, planes: np.ndarray) -> Column:
    """Projections of a dense row, one per direction."""
    dims, features = planes.shape
    if dims * features <= 256:  # unrolled, so it stays in generated code
        rows = []
        for weights in planes.tolist():
            terms = [F.get(x, F.lit(i)) * w for i, w in enumerate(weights)]
            total = terms[0]
            for term in terms[1:]:
                total = total + term
            rows.append(total)
        return F.array(*rows)
    table = F.array(*[F.array(*map(F.lit, row)) for row in planes.tolist()])
    return F.transform(
        table, lambda w: F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)
    )


def plane_rows(spark: SparkSession, dims: int, features: int) -> DataFrame:
    """Unit directions in long form (dim, feature, w), for feature sets too wide for a literal.

    Every task draws the same stream and keeps its own direction, block by block.
    """
    block = 1 << 16

    def draw(batches):
        import pandas as pd

        for batch in batches:
            for dim in batch["id"]:
                rng = np.random.RandomState(seed=PLANE_SEED)
                skip = int(dim) * features
                while skip > 0:
                    rng.uniform(low=-1, size=min(block, skip))
                    skip -= block
                for start in range(0, features, block):
                    width = min(block, features - start)
                    yield pd.DataFrame({"dim": int(dim), "feature": np.arange(start, start + width), "w": rng.uniform(low=-1, size=width)})

    drawn = spark.range(dims).repartition(dims).mapInPandas(draw, "dim int, feature long, w double")
    norms = drawn.groupBy("dim").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return drawn.join(F.broadcast(norms), "dim").select("dim", "feature", (F.col("w") / F.col("_norm")).alias("w"))


def project_sparse(weights: DataFrame, planes: DataFrame, ids: Sequence[str], feature: str = "term_id") -> DataFrame:
    """Projections of long-form rows (ids, feature, weight) as (ids, dim, value).

    Rows without any known feature have no projections; callers that need them join them back.
    """
    packed = planes.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("dim", "w"))).alias("_ws"))
    joined = weights.join(broadcast_if_small(packed), F.col(feature) == F.col("feature"))
    spread = joined.select(*ids, "weight", F.explode("_ws").alias("_p"))
    return spread.groupBy(*ids, F.col("_p.dim").alias("dim")).agg(F.sum(F.col("weight") * F.col("_p.w")).alias("value"))


# --- fitting -----------------------------------------------------------------------------------


def projection_cells(long: DataFrame, by: Sequence[str], epsilon: Column) -> DataFrame:
    """Aggregate projections (by, dim, value) into cells of half the gap width."""
    by = list(by)
    stats = long.groupBy(*by, "dim").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("rows"))
    stats = stats.withColumn("gap", (F.col("high") - F.col("low")) * epsilon)
    located = long.join(settled(stats), [*by, "dim"])
    cell = F.when(F.col("gap") > 0, F.floor((F.col("value") - F.col("low")) / (F.col("gap") / 2))).otherwise(0)
    return located.groupBy(*by, "dim", cell.alias("cell")).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("members"),
        F.first("low").alias("low"), F.first("high").alias("high"), F.first("gap").alias("gap"), F.first("rows").alias("rows"),
    )


def merge_cells(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join neighbouring cells to islands wherever the next projection is nearer than the gap."""
    ordered = Window.partitionBy(*by, "dim").orderBy("cell")
    previous = F.lag("hi").over(ordered)
    # Without any spread every row is an island of its own, and all of them coincide.
    starts = F.when(previous.isNull() | ~(F.col("lo") < previous + F.col("gap")), 1).otherwise(0)
    members = F.when(F.col("gap") > 0, F.col("members")).otherwise(1)
    numbered = cells.withColumn("_start", starts).withColumn("members", members)
    numbered = numbered.withColumn("island", F.sum("_start").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "dim", "island").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("members").alias("members"),
        F.first("low").alias("low"), F.first("high").alias("high"), F.first("gap").alias("gap"), F.first("rows").alias("rows"),
    )


def keep_intervals(islands: DataFrame, box_thr: Column, closed: bool = False) -> DataFrame:
    """Islands with enough members beyond their first; open intervals are widened."""
    extra, least = F.col("members") - 1, F.col("rows") * box_thr
    if closed:
        return islands.where(extra >= least)
    return islands.where(extra > least).withColumn("lo", F.col("lo") - WIDENING).withColumn("hi", F.col("hi") + WIDENING)


def fit_intervals(long: DataFrame, by: Sequence[str], params: RPParams) -> DataFrame:
    islands = merge_cells(projection_cells(long, by, F.lit(params.epsilon)), by)
    return keep_intervals(islands, F.lit(params.box_thr), params.closed)


# --- scoring -----------------------------------------------------------------------------------

_LOOKUP_WIDTH = 4 * WIDENING  # lookup cells are never narrower than what widening can add


def lookup_width(gap: Column) -> Column:
    return F.greatest(gap / 2, F.lit(_LOOKUP_WIDTH))


def lookup_cell(value: Column, low: Column, gap: Column) -> Column:
    return F.floor((value - low) / lookup_width(gap))


def interval_cells(intervals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Intervals by lookup cell: a projection meets all its candidates through an equi-join."""
    first, last = (lookup_cell(F.col(c), F.col("low"), F.col("gap")) for c in ("lo", "hi"))
    spread = intervals.withColumn("cell", F.explode(F.sequence(first, last)))
    return spread.groupBy(*by, "dim", "cell").agg(
        F.collect_list(F.struct("lo", "hi")).alias("spans"), F.first("low").alias("low"), F.first("gap").alias("gap")
    )


def inside(value: Column, closed: bool) -> Callable[[Column], Column]:
    if closed:
        return lambda s: (s["lo"] <= value) & (value <= s["hi"])
    return lambda s: (s["lo"] < value) & (value < s["hi"])


def score_long(long: DataFrame, intervals: DataFrame, by: Sequence[str], ids: Sequence[str], closed: bool = False) -> DataFrame:
    """Directions that accept each row: (by, ids, hits), through an equi-join on the lookup cell.

    Cells are computed once and broadcast where they are small; the long rows then meet them where they are.
    """
    by, ids = list(by), [i for i in ids if i not in by]
    cells = materialize(interval_cells(intervals, by))
    frames = cells.select(*by, "dim", "low", "gap").distinct()
    located = long.join(broadcast_if_small(frames), [*by, "dim"], "left")
    located = located.withColumn("cell", lookup_cell(F.col("value"), F.col("low"), F.col("gap"))).drop("low", "gap")
    joined = located.join(broadcast_if_small(cells.drop("low", "gap")), [*by, "dim", "cell"], "left")
    hit = F.coalesce(F.exists("spans", inside(F.col("value"), closed)), F.lit(False))
    return joined.groupBy(*by, *ids).agg(F.count_if(hit).cast("int").alias("hits"))


def accept_rule(hits: Column, params: RPParams) -> Column:
    if params.agg_abs:
        return (params.D - hits) < params.agg_abs
    least = params.D * params.agg_thr
    return hits >= least if params.closed else hits > least


def decision(hits: Column, dims: int) -> Column:
    return hits / F.lit(dims)


# --- the fitted model as a classifier of keys ----------------------------------------------------


@dataclass
class RPModel:
    """Fitted intervals per table, with the features they were fitted on.

    ``features`` turns the columns of a key row into the dense array ``x``.
    """

    by: list[str]
    params: RPParams
    planes: np.ndarray
    intervals: DataFrame
    features: Callable[[], Column]
    limit: int = BROADCAST_BYTES
    rule: Callable[[Column], Column] | None = None  # replaces the decision rule of ``params``
    _facts: dict = field(default_factory=dict)

    def decide(self, hits: Column) -> Column:
        return self.rule(hits) if self.rule else accept_rule(hits, self.params)

    def prepare(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_x", self.features()).withColumn("_v", project(F.col("_x"), self.planes)).drop("_x")

    def fits_broadcast(self) -> bool:
        """Whether the packed lookup arrays are small, by their measured size, and one span per cell suffices."""
        if not self._facts:
            cells = interval_cells(self.intervals, self.by).agg(F.count("*").alias("cells"), F.max(F.size("spans")).alias("spans"))
            frames = self.intervals.select(*self.by, "dim").distinct().agg(F.count("*").alias("frames"))
            row = cells.withColumn("frames", frames.scalar()).first()
            self._facts["bytes"] = row["frames"] * (2 / self.params.epsilon + 4) * 16
            self._facts["spans"] = row["spans"] or 0
        few = self.params.D <= PACKED_DIMS and self._facts["spans"] <= 1
        return few and self._facts["bytes"] <= self.limit

    def packed(self) -> list[DataFrame]:
        """Per table, the ends of the interval at every lookup cell (NULL where none), ``JOINED_DIMS`` directions at a time."""
        frames = self.intervals.groupBy(*self.by, "dim").agg(
            F.first("low").alias("low"), F.first("high").alias("high"), F.first("gap").alias("gap")
        )
        top = lookup_cell(F.col("high"), F.col("low"), F.col("gap")) + 1
        bottom = lookup_cell(F.col("low") - WIDENING, F.col("low"), F.col("gap"))
        dense = frames.withColumn("cell", F.explode(F.sequence(bottom, top))).join(
            interval_cells(self.intervals, self.by).select(*self.by, "dim", "cell", F.get("spans", F.lit(0)).alias("_s")),
            [*self.by, "dim", "cell"], "left",
        )
        dims = materialize(dense.groupBy(*self.by, "dim").agg(
            F.first("low").alias("low"), F.first("gap").alias("gap"), F.min("cell").alias("base"),
            F.sort_array(F.collect_list(F.struct("cell", F.col("_s.lo").alias("lo"), F.col("_s.hi").alias("hi")))).alias("_c"),
        ))
        parts = []
        for start in range(0, self.params.D, JOINED_DIMS):
            columns, chosen = [], range(start, min(start + JOINED_DIMS, self.params.D))
            for d in chosen:
                here = F.col("dim") == d
                for name, value in (("low", F.col("low")), ("width", lookup_width(F.col("gap"))), ("base", F.col("base")), ("lo", F.col("_c.lo")), ("hi", F.col("_c.hi"))):
                    columns.append(F.first(F.when(here, value), ignorenulls=True).alias(f"_{name}{d}"))
            parts.append(dims.where(F.col("dim").isin(*chosen)).groupBy(*self.by).agg(*columns))
        return parts

    def accept(self, rows: DataFrame) -> DataFrame:
        return self._accept_packed(rows) if self.fits_broadcast() else self._accept_joined(rows)

    def _accept_packed(self, rows: DataFrame) -> DataFrame:
        """Map-side: no lambda is involved, so the lookup stays in generated code and copies no array."""
        joined = rows.withColumn("_hits", F.lit(0))
        for start, part in zip(range(0, self.params.D, JOINED_DIMS), self.packed()):
            packed, address = beside(part, self.by)
            # Asking for more partitions than there are moves nothing, but ends a piece of generated code.
            joined, hits = joined.coalesce(1 << 20).join(F.broadcast(packed), same_address(self.by), "left"), F.lit(0)
            for d in range(start, min(start + JOINED_DIMS, self.params.D)):
                value = F.get(F.col("_v"), F.lit(d))
                place = (F.floor((value - F.col(f"_low{d}")) / F.col(f"_width{d}")) - F.col(f"_base{d}")).cast("int")
                lo, hi = F.get(F.col(f"_lo{d}"), place), F.get(F.col(f"_hi{d}"), place)
                found = (lo <= value) & (value <= hi) if self.params.closed else (lo < value) & (value < hi)
                hits = hits + F.when(found, 1).otherwise(0)
            joined = joined.select(*rows.columns, (F.col("_hits") + F.when(address, hits).otherwise(0)).alias("_hits"))
        # A table without any interval has no hits; the decision rule answers for it as for any other.
        return joined.select(*rows.columns, F.coalesce(self.decide(F.col("_hits")), F.lit(False)).alias("accepted"))

    def _accept_joined(self, rows: DataFrame) -> DataFrame:
        ids = [*self.by, "_v"]  # equal projections in the same table get the same answer
        distinct = rows.select(*ids).distinct()
        long = distinct.select(*ids, F.posexplode("_v").alias("dim", "value"))
        scored = score_long(long, self.intervals, self.by, ["_v"], self.params.closed)
        return rows.join(scored, ids).withColumn("accepted", self.decide(F.col("hits"))).drop("hits")


def fit(rows: DataFrame, by: Sequence[str], params: RPParams, features: Callable[[], Column], width: int) -> RPModel:
    """One model per table from key rows; ``width`` is the number of features."""
    planes = unit_planes(params.D, width)
    featured = rows.select(*by, features().alias("x"))  # a projection of its own, so features are computed once
    long = featured.select(*by, F.posexplode(project(F.col("x"), planes)).alias("dim", "value"))
    intervals = materialize(fit_intervals(long, by, params))  # fitted state: at most dims/epsilon rows per table
    return RPModel(list(by), params, planes, intervals, features)


def model_bits(intervals: DataFrame, by: Sequence[str], dims: int, width: int) -> DataFrame:
    """Parameter bits per table: as counted from the first direction only, and with all intervals."""
    counted = intervals.groupBy(*by).agg(
        F.count_if(F.col("dim") == 0).alias("_first"), F.count("*").alias("_all")
    )
    return counted.select(
        *by, ((dims * width + dims * F.col("_first")) * 64).alias("bits"), ((dims * width + F.col("_all")) * 64).alias("true_bits")
    )


# --- kernel features -----------------------------------------------------------------------------


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)


def kernel_project(x: Column, planes: np.ndarray, kernel: str, gamma: float = 1.0, offset: float = 1.0, degree: int = 2) -> Column:
    """Kernel values against the directions: 'g' is ``exp(-gamma |x-p|^2)``, 'p' is ``(x.p + offset)^degree``."""
    table = F.array(*[F.array(*map(F.lit, row)) for row in planes.tolist()])
    if kernel == "g":
        gap = lambda p: F.aggregate(F.zip_with(x, p, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
        return F.transform(table, lambda p: F.exp(-gamma * gap(p)))
    if kernel == "p":
        return F.transform(table, lambda p: F.pow(dot(x, p) + offset, F.lit(float(degree))))
    raise ValueError("kernel is 'g' or 'p'")
