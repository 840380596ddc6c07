"""Gaussian mixtures, one per table, with full covariance over two features.

Fitting packs rows in blocks once; a block meets its table's components in every iteration and leaves the
sums that the next estimate needs.  Rows of a block lie near each other, and components too far from all
of them to count are left out; see ``NEGLIGIBLE``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.session import broadcast_if_small, materialize, settled

COVARIANCE_FLOOR = 1e-6  # fixed value: added to the diagonal
# Rows of a block, rows of one task that are packed together, and neighbouring rows that are scored together.
BLOCK_ROWS = 1 << 16
PACK_ROWS = 1 << 19
RUN_ROWS = 512
# Logarithm below which a responsibility is taken as nothing: 2e-22 is less than the rounding of any sum it would enter.
NEGLIGIBLE = -50.0


def component_count(rows: Column) -> Column:
    """How many components a table of this size gets.  Fixed values: 100 above 10000 rows, a tenth of the rows below 60, else 9."""
    return F.when(rows > 10000, 100).when(rows < 60, F.greatest(F.lit(1), F.floor(rows / 10))).otherwise(9).cast("int")


SUMS = ["_r", "_a", "_b", "_aa", "_ab", "_bb", "ll_sum"]


def estimate(weighted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weights, means and covariances from responsibilities: rows (by, component, r, x0, x1, ll)."""
    r, a, b = F.col("r"), F.col("x0"), F.col("x1")
    sums = [r, r * a, r * b, r * a * a, r * a * b, r * b * b, r * F.col("ll")]
    return of_sums(weighted.select(*by, "component", *[v.alias(n) for v, n in zip(sums, SUMS)]), by)


def of_sums(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weights, means and covariances from partial sums: rows (by, component, ``SUMS``).

    A component whose responsibilities add up to less than a billionth of one row has no mean and is dropped.
    """
    sums = sums.groupBy(*by, "component").agg(*[F.sum(n).alias(n) for n in SUMS])
    totals = sums.groupBy(*by).agg(F.sum("_r").alias("_n"))
    joined = sums.where("_r > 1e-9").join(totals, list(by))
    m0, m1 = F.col("_a") / F.col("_r"), F.col("_b") / F.col("_r")
    return joined.select(
        *by, "component", (F.col("_r") / F.col("_n")).alias("weight"), m0.alias("m0"), m1.alias("m1"),
        (F.greatest(F.col("_aa") / F.col("_r") - m0 * m0, F.lit(0.0)) + COVARIANCE_FLOOR).alias("c00"),
        (F.col("_ab") / F.col("_r") - m0 * m1).alias("c01"),
        (F.greatest(F.col("_bb") / F.col("_r") - m1 * m1, F.lit(0.0)) + COVARIANCE_FLOOR).alias("c11"),
        F.col("_r").alias("r_sum"), "ll_sum",
    )


def packed(components: DataFrame, by: Sequence[str]) -> DataFrame:
    fields = ["component", "weight", "m0", "m1", "c00", "c01", "c11"]
    return components.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_mix"))


def _log_density(c: Column, x0: Column, x1: Column) -> Column:
    det = c["c00"] * c["c11"] - c["c01"] * c["c01"]
    d0, d1 = x0 - c["m0"], x1 - c["m1"]
    distance = (c["c11"] * d0 * d0 - 2 * c["c01"] * d0 * d1 + c["c00"] * d1 * d1) / det
    return F.log(c["weight"]) - math.log(2 * math.pi) - 0.5 * F.log(det) - 0.5 * distance


def with_log_likelihood(rows: DataFrame, components: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add ``_logs`` (per component) and their log-sum-exp ``ll``."""
    joined = rows.join(broadcast_if_small(packed(components, by)), list(by))
    # The largest logarithm is a column of its own: inside the lambda it would be looked for once per component.
    logs = joined.withColumn("_logs", F.transform("_mix", lambda c: _log_density(c, F.col("x0"), F.col("x1"))))
    logs = logs.withColumn("_top", F.array_max("_logs"))
    total = F.aggregate("_logs", F.lit(0.0), lambda t, v: t + F.exp(v - F.col("_top")))
    return logs.withColumn("ll", F.col("_top") + F.log(total)).drop("_top")


def initial_components(rows: DataFrame, by: Sequence[str], accuracy: int = 1000) -> DataFrame:
    """Hard assignment by quantiles of the first feature, one slice per component.

    Start values only: the quantiles are approximate (a rank is off by at most a part in ``accuracy``).
    """
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("x0", [i / 100 for i in range(1, 100)], accuracy).alias("_q"))
    joined = rows.join(settled(sizes.withColumn("_k", component_count(F.col("_n")))), list(by))
    rank = F.size(F.filter("_q", lambda q: q < F.col("x0")))
    component = F.floor(rank * F.col("_k") / 100).cast("int")
    return estimate(joined.select(*by, component.alias("component"), F.lit(1.0).alias("r"), "x0", "x1", F.lit(0.0).alias("ll")), by)


def neighbours(x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """An order of the rows in which every ``RUN_ROWS`` of them lie in a small rectangle."""
    order = np.argsort(x0, kind="stable")
    strip = RUN_ROWS * max(1, math.isqrt(len(order) // RUN_ROWS))
    return np.concatenate([part[np.argsort(x1[part], kind="stable")] for part in np.split(order, range(strip, len(order), strip))])


def blocks_of(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows (by, x0, x1) as blocks (by, x0s, x1s) of one table's rows; a task packs what it reads, so nothing is shuffled."""
    by = list(by)
    known = rows.select(*by, F.col("x0").cast("double"), F.col("x1").cast("double")).where("x0 IS NOT NULL AND x1 IS NOT NULL")
    kinds = dict(known.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", x0s array<double>, x1s array<double>"

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pa.Table.from_batches(held).group_by(by, use_threads=False).aggregate([("x0", "list"), ("x1", "list")])
        lists = [tables.column(c).combine_chunks() for c in ("x0_list", "x1_list")]
        for i in range(tables.num_rows):
            x0, x1 = (v[i].values.to_numpy() for v in lists)
            order = neighbours(x0, x1)
            for start in range(0, len(order), BLOCK_ROWS):
                here = order[start : start + BLOCK_ROWS]
                packed_rows = [pa.array([v[here]], pa.list_(pa.float64())) for v in (x0, x1)]
                yield pa.RecordBatch.from_arrays([*(tables.column(c).slice(i, 1).combine_chunks() for c in by), *packed_rows], names=[*by, "x0s", "x1s"])

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= PACK_ROWS:
                yield from blocks(held)
                held, size = [], 0
        if size:
            yield from blocks(held)

    return materialize(known.mapInArrow(pack, schema))


def moments(x0: np.ndarray, x1: np.ndarray, mix: dict[str, np.ndarray]) -> np.ndarray:
    """``SUMS`` of every component over rows in the order of ``neighbours`` (components x sums)."""
    det = mix["c00"] * mix["c11"] - mix["c01"] * mix["c01"]
    constant = np.log(mix["weight"]) - math.log(2 * math.pi) - 0.5 * np.log(det)
    # The squared distance is u^2 + v^2 with u = (x0 - m0) * e and v = (x1 - m1 - slope * (x0 - m0)) * f.
    slope, e, f = mix["c01"] / mix["c00"], 1 / np.sqrt(mix["c00"]), np.sqrt(mix["c00"] / det)
    out = np.zeros((len(det), len(SUMS)))
    for start in range(0, len(x0), RUN_ROWS):
        a, b = x0[start : start + RUN_ROWS], x1[start : start + RUN_ROWS]
        d0, d1 = (np.array([v.min(), v.max()])[:, None] - m for v, m in ((a, mix["m0"]), (b, mix["m1"])))
        u = d0 * e
        bent = slope * d0
        v = np.stack([d1[0] - bent.max(axis=0), d1[1] - bent.min(axis=0)]) * f
        far = np.maximum(*np.abs(u)) ** 2 + np.maximum(*np.abs(v)) ** 2
        near = sum(np.where(w[0] * w[1] <= 0, 0.0, np.minimum(*np.abs(w)) ** 2) for w in (u, v))
        # Every row is at least as likely as the best component makes the farthest corner; a NaN leaves all components in.
        kept = np.flatnonzero(~(constant - 0.5 * near < (constant - 0.5 * far).max() + NEGLIGIBLE))
        d0 = a[:, None] - mix["m0"][kept]
        d1 = (b[:, None] - mix["m1"][kept] - slope[kept] * d0) * f[kept]
        d0 *= e[kept]
        logs = constant[kept] - 0.5 * (d0 * d0 + d1 * d1)
        top = logs.max(axis=1, keepdims=True)
        r = np.exp(logs - top)
        total = r.sum(axis=1, keepdims=True)
        r /= total
        ll = (top + np.log(total))[:, 0]
        out[kept] += r.T @ np.stack([np.ones(len(a)), a, b, a * a, a * b, b * b, ll], axis=1)
    return out


def expectation(blocks: DataFrame, components: DataFrame, by: Sequence[str]) -> DataFrame:
    """Partial sums of every component over each block: (by, component, ``SUMS``)."""
    by = list(by)
    met = blocks.join(broadcast_if_small(packed(components, by)), by)
    kinds = dict(blocks.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", component int, " + ", ".join(f"{c} double" for c in SUMS)

    def local(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                mix = batch.column("_mix")[i].values
                fields = {c: mix.field(c).to_numpy() for c in ("weight", "m0", "m1", "c00", "c01", "c11")}
                if (fields["c00"] * fields["c11"] <= fields["c01"] ** 2).any():
                    continue  # a covariance without a density: the table has no mixture
                found = moments(*(batch.column(c)[i].values.to_numpy() for c in ("x0s", "x1s")), fields)
                where = pa.array(np.full(len(found), i))
                columns = [batch.column(c).take(where) for c in by] + [mix.field("component")] + [pa.array(found[:, j]) for j in range(len(SUMS))]
                yield pa.RecordBatch.from_arrays(columns, names=[*by, "component", *SUMS])

    return met.mapInArrow(local, schema)


def fit(rows: DataFrame, by: Sequence[str], max_iter: int = 100, tolerance: float = 1e-3) -> tuple[DataFrame, list[float]]:
    """Expectation maximisation over all tables at once; returns components and the mean log-likelihoods.

    The rows are packed once and read once per iteration, and only component sums are shuffled.  The components
    (tables x components rows) are checkpointed so that plans do not grow with the iterations.  Rows with a null
    take no part.
    """
    by = list(by)
    components, trace = materialize(initial_components(rows, by)), []
    blocks = blocks_of(rows, by)
    for _ in range(max_iter):
        components = materialize(of_sums(expectation(blocks, components, by), by))
        total = components.agg(F.sum("ll_sum") / F.sum("r_sum")).first()[0]
        trace.append(total)
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) < tolerance:
            break
    return components, trace


def likelihood_band(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the training log-likelihood."""
    return scored.groupBy(*by).agg(F.avg("ll").alias("mean"), F.stddev_pop("ll").alias("sigma"))


def band_prediction(ll: Column, mean: Column, sigma: Column, factor: float, floor: float | None = None) -> Column:
    """1 inside the band; with ``floor`` the band has that least width and includes its edge."""
    distance, band = F.abs(ll - mean), factor * sigma
    accepted = distance < band if floor is None else distance <= F.greatest(band, F.lit(floor))
    return F.when(accepted, 1).otherwise(-1)


def resample(components: DataFrame, by: Sequence[str], scale: int = 10000, seed: int = 42) -> DataFrame:
    """``int(weight * scale)`` draws from each component."""
    draws = F.floor(F.col("weight") * scale).cast("int")
    spread = components.where(draws > 0).withColumn("draw", F.explode(F.sequence(F.lit(1), draws)))
    # The draws follow from the component's address, so they do not change when a task is repeated.
    unit = lambda salt: (F.pmod(F.xxhash64(*by, "component", "draw", F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    radius, angle = F.sqrt(-2 * F.log(unit(1))), 2 * math.pi * unit(2)
    l00 = F.sqrt("c00")
    l10 = F.col("c01") / l00
    l11 = F.sqrt(F.greatest(F.col("c11") - l10 * l10, F.lit(0.0)))
    u, v = radius * F.cos(angle), radius * F.sin(angle)
    return spread.select(*by, "component", "draw", (F.col("m0") + l00 * u).alias("x0"), (F.col("m1") + l10 * u + l11 * v).alias("x1"))
