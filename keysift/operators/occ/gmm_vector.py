"""Gaussian mixtures with full covariance in any number of dimensions, one per table.

Rows are packed in blocks; a block meets its table's components once per iteration and leaves, for each
component, the sums that the next estimate needs, so an iteration shuffles sums and no rows.  A
covariance is kept as its Cholesky factor, and moments are taken about the component's last mean, which
keeps them exact far from the origin.  A component that covers fewer rows than it has dimensions, or
rows in a plane, has a singular covariance: its diagonal is raised until the factor exists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.operators.occ import chunked
from keysift.operators.occ.gmm import COVARIANCE_FLOOR, NEGLIGIBLE, component_count
from keysift.session import broadcast_if_small, materialize, settled

# Numbers of one block, and rows that are scored together.
BLOCK_NUMBERS = 1 << 18
CHUNK_ROWS = 1 << 14
# A component whose responsibilities add up to less has no mean and is dropped.
LEAST_ROWS = 1e-9
# Dimensions whose distance alone tells that a component is too far from a row to count.
LEAD_DIMS = 8
NOTHING = math.exp(NEGLIGIBLE)

SUMS = "component int, r double, first array<double>, second array<double>, ll double, shift array<double>"


def blocks_of(rows: DataFrame, by: Sequence[str], dims: int) -> DataFrame:
    """Rows (by, x) as blocks (by, ``x`` end to end); rows with a null in them are left out."""
    known = rows.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v))).where(F.size("x") == dims)
    size = max(1, BLOCK_NUMBERS // dims)
    parts = settled(known.groupBy(*by).agg(F.expr(f"count(*) div {size} + 1").alias("_parts")))
    dealt = known.join(parts, list(by)).withColumn("_block", F.pmod(F.xxhash64("x"), F.col("_parts")))
    return materialize(dealt.groupBy(*by, "_block").agg(F.flatten(F.collect_list("x")).alias("x")).drop("_block"))


def packed(components: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per table: its components in order."""
    return components.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("component", "weight", "mean", "factor"))).alias("_mix"))


class Mixture:
    """Weights, means and inverse Cholesky factors of one table."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, factors: np.ndarray):
        self.means = means
        self.inverse = np.linalg.inv(factors)
        diagonal = np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
        self.constant = np.log(weights) - means.shape[1] / 2 * math.log(2 * math.pi) - diagonal

    def _density(self, k: int, x: np.ndarray, dims: int) -> np.ndarray:
        """Weighted log-densities from the first ``dims`` dimensions: a factor is triangular, so those of more are no greater."""
        z = (x[:, :dims] - self.means[k, :dims]) @ self.inverse[k, :dims, :dims].T
        return self.constant[k] - 0.5 * np.einsum("ij,ij->i", z, z)

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Weighted log-densities, one row for each row of ``x``; minus infinity where a responsibility is below ``NEGLIGIBLE``."""
        whole, lead = x.shape[1], min(LEAD_DIMS, x.shape[1])
        most = np.stack([self._density(k, x, lead) for k in range(len(self.means))], axis=1)
        if lead == whole:
            return most
        # Every row is at least as likely as the component that looks best makes it.
        best, least = most.argmax(axis=1), np.empty(len(x))
        for k in np.unique(best):
            least[best == k] = self._density(k, x[best == k], whole)
        out = np.full(most.shape, -np.inf)
        for k in range(len(self.means)):
            near = np.flatnonzero(~(most[:, k] < least + NEGLIGIBLE))
            if len(near):
                out[near, k] = self._density(k, x if len(near) == len(x) else x[near], whole)
        return out


def log_sum(logs: np.ndarray) -> np.ndarray:
    top = logs.max(axis=1)
    return top + np.log(np.exp(logs - top[:, None]).sum(axis=1))


def _sums(blocks: DataFrame, by: list[str], dims: int, weigh) -> DataFrame:
    """Sums of every component over all blocks; ``weigh(batch, i, x)`` gives numbers, responsibilities, log-likelihoods and shifts."""
    kinds = dict(blocks.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + SUMS

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def packed_sums() -> pa.RecordBatch:
            rows = [(*key, float(r), a.tolist(), b.ravel().tolist(), float(ll), m.tolist()) for key, (r, a, b, ll, m) in held.items()]
            kinds = [batch.schema.field(c).type for c in by] + [pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*by, "component", "r", "first", "second", "ll", "shift"])

        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.column("x")[i].values.to_numpy().reshape(-1, dims)
                table = tuple(batch.column(c)[i].as_py() for c in by)
                if held and next(iter(held))[: len(by)] != table:
                    yield packed_sums()
                    held = {}
                numbers, r, ll, shifts = weigh(batch, i, x)
                for k, number in enumerate(numbers):
                    # A NaN stays in.
                    own = np.flatnonzero(~(r[:, k] <= NOTHING))
                    y, own_r = x[own] - shifts[k], r[own, k]
                    weighed = y * own_r[:, None]
                    sums = [own_r.sum(), weighed.sum(axis=0), weighed.T @ y, (own_r * ll[own]).sum(), shifts[k]]
                    old = held.get((*table, number))
                    held[(*table, number)] = sums if old is None else [*(a + b for a, b in zip(old[:4], sums)), old[4]]
        if held:
            yield packed_sums()

    return blocks.mapInArrow(local, schema)


def estimate(sums: DataFrame, by: list[str], dims: int) -> DataFrame:
    """Weights, means and Cholesky factors from the components' sums: (by, component, weight, mean, factor, r_sum, ll_sum)."""
    kinds = dict(sums.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", component int, mean array<double>, factor array<double>, r_sum double, ll_sum double"

    def add(parts: pa.Table) -> pa.Table:
        r = parts.column("r").to_numpy().sum()
        first, second = (np.sum([np.asarray(v) for v in parts.column(c).to_pylist()], axis=0) for c in ("first", "second"))
        head = [parts.column(c).slice(0, 1) for c in (*by, "component")]
        names = [*by, "component", "mean", "factor", "r_sum", "ll_sum"]
        if r <= LEAST_ROWS:
            return pa.table([*(h.slice(0, 0) for h in head), pa.array([], pa.list_(pa.float64())), pa.array([], pa.list_(pa.float64())), pa.array([], pa.float64()), pa.array([], pa.float64())], names=names)
        moved = first / r
        covariance = second.reshape(dims, dims) / r - np.outer(moved, moved)
        mean = np.asarray(parts.column("shift")[0].as_py()) + moved
        factor = cholesky(covariance)
        columns = [pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([factor.ravel().tolist()], pa.list_(pa.float64()))]
        return pa.table([*head, *columns, pa.array([r]), pa.array([parts.column("ll").to_numpy().sum()])], names=names)

    made = sums.groupBy(*by, "component").applyInArrow(add, schema)
    made = materialize(made)
    totals = made.groupBy(*by).agg(F.sum("r_sum").alias("_n"))
    weighed = made.join(broadcast_if_small(totals), by).withColumn("weight", F.col("r_sum") / F.col("_n"))
    return weighed.select(*by, "component", "weight", "mean", "factor", "r_sum", "ll_sum")


def of_parts(rows: DataFrame, by: Sequence[str], dims: int) -> DataFrame:
    """The mixture whose components are given parts of the rows: ``rows`` holds ``by``, ``component`` and ``x``."""
    by = list(by)
    blocks = blocks_of(rows.select(*by, F.col("component").cast("int").alias("part"), "x"), [*by, "part"], dims)

    def weigh(batch, i, x):
        return [batch.column("part")[i].as_py()], np.ones((len(x), 1)), np.zeros(len(x)), np.zeros((1, dims))

    return materialize(estimate(_sums(blocks, by, dims, weigh), by, dims))


def cholesky(covariance: np.ndarray) -> np.ndarray:
    """The factor of a covariance with the floor on its diagonal, which rises tenfold while there is none."""
    covariance, floor = (covariance + covariance.T) / 2, COVARIANCE_FLOOR
    while True:
        try:
            return np.linalg.cholesky(covariance + floor * np.eye(len(covariance)))
        except np.linalg.LinAlgError:
            floor *= 10


def _initial(blocks: DataFrame, rows: DataFrame, by: list[str], dims: int, accuracy: int = 1000) -> DataFrame:
    """Start values: slices of the first feature by approximate quantiles, one for each component."""
    first = F.col("x")[0]
    cuts = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx(first, [i / 100 for i in range(1, 100)], accuracy).alias("_q"))
    joined = blocks.join(settled(cuts.withColumn("_k", component_count(F.col("_n"))).drop("_n")), by)

    def weigh(batch, i, x):
        k = batch.column("_k")[i].as_py()
        place = np.searchsorted(batch.column("_q")[i].values.to_numpy(), x[:, 0], "left") * k // 100
        numbers = np.unique(place).tolist()
        return numbers, (place[:, None] == np.array(numbers)[None, :]).astype(float), np.zeros(len(x)), np.zeros((len(numbers), dims))

    return estimate(_sums(joined, by, dims, weigh), by, dims)


def _mixture(batch, i: int, dims: int) -> tuple[list[int], Mixture]:
    mix = batch.column("_mix")[i].values
    weights = mix.field("weight").to_numpy()
    means = mix.field("mean").flatten().to_numpy().reshape(-1, dims)
    factors = mix.field("factor").flatten().to_numpy().reshape(-1, dims, dims)
    return mix.field("component").to_pylist(), Mixture(weights, means, factors)


def fit(rows: DataFrame, by: Sequence[str], dims: int, max_iter: int = 100, tolerance: float = 1e-3) -> tuple[DataFrame, list[float]]:
    """Expectation maximisation over all tables at once; returns the components and the mean log-likelihoods.

    ``rows`` holds ``by`` and ``x``, an array of ``dims`` numbers.  Rows with a null, a NaN or another number of
    dimensions take no part.  An empty table gives no components.
    """
    by = list(by)
    rows = rows.select(*by, "x")
    blocks = blocks_of(rows, by, dims)
    opened = rows.where(F.size("x") == dims).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    components, trace = materialize(_initial(blocks, opened, by, dims)), []

    def weigh(batch, i, x):
        numbers, mixture = _mixture(batch, i, dims)
        logs = mixture.log_densities(x)
        ll = log_sum(logs)
        return numbers, np.exp(logs - ll[:, None]), ll, mixture.means

    for _ in range(max_iter):
        met = blocks.join(broadcast_if_small(materialize(packed(components, by))), by)
        components = materialize(estimate(_sums(met, by, dims, weigh), by, dims))
        total = components.agg(F.sum("ll_sum") / F.sum("r_sum")).first()[0]
        if total is None:
            break
        trace.append(total)
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) < tolerance:
            break
    return components, trace


def with_log_likelihood(rows: DataFrame, components: DataFrame, by: Sequence[str], dims: int) -> DataFrame:
    """All rows with ``ll``; null where a row has a null or another number of dimensions, or its table has no mixture."""

    def answer(held: pa.Table, asked: pa.Table) -> pa.Array:
        out = np.full(asked.num_rows, np.nan)
        whole, x = chunked.dense(asked.column("x"), dims)
        whole, x = whole[~np.isnan(x).any(axis=1)], x[~np.isnan(x).any(axis=1)]
        if held.num_rows and len(whole):
            _, mixture = _mixture(held.combine_chunks().to_batches()[0], 0, dims)
            out[whole] = log_sum(mixture.log_densities(x))
        return pa.array(out, mask=np.isnan(out))

    return chunked.answered(rows, packed(components, by), by, answer, "ll", CHUNK_ROWS)
