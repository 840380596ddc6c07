"""One-class support vector machines on random Fourier features, one per table.

The machine looks for the ``w`` and ``rho`` of least ``|w|^2 / 2 - rho + sum(max(0, rho - w.z)) / (nu n)``.
At its solution ``w`` is a weighted mean of the rows' features in which no row counts for more than
``1 / (nu n)``.  Each round looks for the best such mean against the present ``w``, that of the share
``nu`` of the rows that score lowest, and moves ``w`` towards it by exact line search.  The distance left,
``w.(w - mean)``, bounds how far the objective is from its optimum (but for what rows of one score range
differ in) and ends the search.

A round is one pass over blocks of rows.  Tasks leave counts and feature sums by score range, from which
every table's lowest share follows; rows are not sorted or moved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.operators.occ import chunked, gmm_vector
from keysift.operators.occ.rbf import RBFParams, fourier_basis
from keysift.operators.ordering import grouped_order_statistics
from keysift.session import broadcast_if_small, materialize

# Ranges of scores that a round tells apart, and rows that are scored together.
RANGES = 128
CHUNK_ROWS = 1 << 16
# Rows whose features are made and added up at a time, which then stay in the processor's cache.
STEP_ROWS = 1 << 11
# Tables whose sums a task holds at one time.
TABLES_HELD = 64


@dataclass(frozen=True)
class SVMParams:
    """``tol`` is the distance from the optimum, relative to ``|w|^2``, at which a table is settled."""

    nu: float = 0.1
    gamma: float = 0.5
    tol: float = 1e-3
    features: int = 64
    max_iter: int = 60

    def map(self, x: np.ndarray) -> np.ndarray:
        weights, phases = fourier_basis(RBFParams(gamma=self.gamma, features=self.features), x.shape[1])
        z = x @ weights.T
        z += phases
        np.cos(z, out=z)
        z *= np.sqrt(2.0 / self.features)
        return z


def lowest_mean(counts: np.ndarray, sums: np.ndarray, share: float) -> np.ndarray:
    """The mean features of the ``share`` of rows in the lowest ranges; rows of the range on the edge count in part, all alike."""
    wanted = share * counts.sum()
    before = np.cumsum(counts) - counts
    part = np.clip((wanted - before) / np.maximum(counts, 1), 0.0, 1.0)
    return (sums * part[:, None]).sum(axis=0) / wanted


def range_sums(x: np.ndarray, w: np.ndarray, low: float, high: float, params: SVMParams) -> list:
    """Counts and feature sums of the rows by score range, and the least and the greatest score."""
    counts, totals, ends = np.zeros(RANGES), np.zeros((RANGES, params.features)), []
    for start in range(0, len(x), STEP_ROWS):
        z = params.map(x[start : start + STEP_ROWS])
        scores = z @ w
        # The ranges divide the scores of the last round; what moved beyond them falls into the outer ones.
        place = np.zeros(len(z), np.int64)
        if high > low:
            place = np.clip(((scores - low) / (high - low) * RANGES).astype(np.int64), 0, RANGES - 1)
        own = np.bincount(place, minlength=RANGES)
        met = np.flatnonzero(own)
        counts += own
        totals[met] += (place[:, None] == met).T.astype(float) @ z
        ends += [scores.min(), scores.max()]
    return [counts, totals, float(min(ends)), float(max(ends))]


def line_step(w: np.ndarray, target: np.ndarray) -> float:
    """How far to go from ``w`` to ``target`` for the least norm."""
    way = w - target
    length = float(way @ way)
    return min(1.0, max(0.0, float(w @ way) / length)) if length > 0 else 0.0


@dataclass
class SVMModel:
    by: list[str]
    params: SVMParams
    dims: int
    weights: DataFrame  # (by, w, gap, objective)
    threshold: DataFrame  # (by, rho)
    trace: list[float]

    def score(self, rows: DataFrame) -> DataFrame:
        """All rows with ``score`` = ``w.z - rho``; null where ``x`` holds a null or the table has no model."""
        params, dims = self.params, self.dims

        def answer(held: pa.Table, asked: pa.Table) -> pa.Array:
            out = np.full(asked.num_rows, np.nan)
            whole, x = chunked.dense(asked.column("x"), dims)
            if held.num_rows and len(whole):
                w, rho = np.asarray(held.column("w")[0].as_py()), held.column("rho")[0].as_py()
                out[whole] = np.concatenate([params.map(x[i : i + STEP_ROWS]) @ w for i in range(0, len(x), STEP_ROWS)]) - rho
            return pa.array(out, mask=np.isnan(out))

        fitted = self.weights.select(*self.by, "w").join(broadcast_if_small(self.threshold), self.by)
        return chunked.answered(rows, fitted, self.by, answer, "score", CHUNK_ROWS)

    def predict(self, rows: DataFrame) -> DataFrame:
        """1 on the boundary and inside, else -1."""
        return self.score(rows).withColumn("prediction", F.when(F.col("score") >= 0, 1).otherwise(-1))


def fit(rows: DataFrame, by: Sequence[str], params: SVMParams, dims: int) -> SVMModel:
    """Fit all tables at once; ``rows`` holds ``by`` and ``x``.

    Rows with a null, a NaN or another number of dimensions take no part.  ``trace`` is the sum of the
    tables' objectives ``|w|^2 / 2`` (of the dual, which falls) after each round.
    """
    by = list(by)
    blocks = gmm_vector.blocks_of(rows.select(*by, "x"), by, dims)
    kinds = dict(blocks.dtypes)
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    state = f"{keys}, w array<double>, low double, high double, gap double, objective double"
    sums = f"{keys}, counts array<double>, sums array<double>, low double, high double"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def packed() -> pa.RecordBatch:
            rows = [(*table, counts.tolist(), totals.ravel().tolist(), low, high) for table, (counts, totals, low, high) in held.items()]
            kinds = [batch.schema.field(c).type for c in by] + [pa.list_(pa.float64())] * 2 + [pa.float64()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*by, "counts", "sums", "low", "high"])

        for batch in batches:
            for i in range(batch.num_rows):
                table = tuple(batch.column(c)[i].as_py() for c in by)
                if len(held) >= TABLES_HELD and table not in held:
                    yield packed()
                    held = {}
                x = batch.column("x")[i].values.to_numpy().reshape(-1, dims)
                first = "w" not in batch.schema.names
                w = np.zeros(params.features) if first else np.asarray(batch.column("w")[i].as_py())
                low, high = (0.0, 0.0) if first else (batch.column(c)[i].as_py() for c in ("low", "high"))
                own = range_sums(x, w, low, high, params)
                old = held.get(table)
                held[table] = own if old is None else [old[0] + own[0], old[1] + own[1], min(old[2], own[2]), max(old[3], own[3])]
        if held:
            yield packed()

    def move(parts: pa.Table) -> pa.Table:
        counts = np.sum([np.asarray(v) for v in parts.column("counts").to_pylist()], axis=0)
        totals = np.sum([np.asarray(v) for v in parts.column("sums").to_pylist()], axis=0).reshape(RANGES, -1)
        old = parts.column("w")[0].as_py() if "w" in parts.column_names else None
        if old is None:
            w, gap = totals.sum(axis=0) / counts.sum(), np.inf
        else:
            w = np.asarray(old)
            target = lowest_mean(counts, totals, params.nu)
            gap = float(w @ (w - target))
            w = w + line_step(w, target) * (target - w)
        low, high = parts.column("low").to_numpy().min(), parts.column("high").to_numpy().max()
        if old is None:  # no scores yet: all that a feature vector of this length can give
            high = float(np.sqrt(w @ w) * np.sqrt(2.0))
            low = -high
        head = [parts.column(c).slice(0, 1) for c in by]
        columns = [pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([low]), pa.array([high]), pa.array([gap]), pa.array([0.5 * float(w @ w)])]
        return pa.table([*head, *columns], names=[*by, "w", "low", "high", "gap", "objective"])

    weights = materialize(blocks.mapInArrow(local, sums).groupBy(*by).applyInArrow(move, state))
    trace: list[float] = []
    for _ in range(params.max_iter):
        # Settled tables are asked no more.
        open_tables = weights.where(F.col("gap") > 2 * params.tol * F.col("objective"))
        if open_tables.isEmpty():
            break
        facts = broadcast_if_small(open_tables.select(*by, "w", "low", "high"))
        parts = blocks.join(facts, by).mapInArrow(local, sums).join(broadcast_if_small(open_tables.select(*by, "w")), by)
        weights = materialize(weights.join(open_tables.select(*by), by, "left_anti").unionByName(parts.groupBy(*by).applyInArrow(move, state)))
        trace.append(weights.agg(F.sum("objective")).first()[0])
    fitted = SVMModel(by, params, dims, weights.select(*by, "w", "gap", "objective"), weights.select(*by, F.lit(0.0).alias("rho")), trace)
    scored = fitted.score(rows.select(*by, "x")).where("score is not null")
    # The boundary: the score that a share ``nu`` of the table's rows does not reach.
    fitted.threshold = materialize(grouped_order_statistics(scored.select(*by, "score"), by, "score", params.nu, "rho"))
    return fitted


def support_ratio(model: SVMModel, rows: DataFrame, slack: float = 0.0) -> DataFrame:
    """Share of the rows on or below the boundary, which alone carry weight."""
    return model.score(rows).groupBy(*model.by).agg((F.count_if(F.col("score") <= slack) / F.count("*")).alias("support_ratio"))
