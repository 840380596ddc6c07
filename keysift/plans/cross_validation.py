"""Cross-validated grid search of a kernel classifier in two passes over the rows, whatever the grid.

The classifier is the least-squares form of the support vector machine, one against the rest: on
features ``z`` it solves ``(Z'Z + I/C) W = Z'Y`` with targets of one and minus one.  All that a fit
needs of its rows are two matrices, so one pass adds them up for each fold; training on all folds but
one is a subtraction, and one decomposition of it gives the weights for every penalty.  A second
pass scores every row with the weights of the fits that did not see it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.operators.occ.rbf import RBFParams, fourier_basis
from keysift.operators.ordering import grouped_ntile
from keysift.session import materialize
from keysift.sources.generators import shuffle_key

# Rows of the matrices that one group adds up.
ROWS_AT_ONCE = 32
MATRIX = "kernel int, fold int, i int, gram array<double>, cross array<double>"
WEIGHTS = "kernel int, fold int, c double, weights array<double>"


@dataclass(frozen=True)
class Kernel:
    """``linear``, or ``rbf`` of a width by so many random frequencies."""

    name: str
    gamma: float = 0.0
    features: int = 256

    def basis(self, dims: int) -> tuple[np.ndarray, np.ndarray]:
        return fourier_basis(RBFParams(gamma=self.gamma, features=self.features), dims)

    def size(self, dims: int) -> int:
        return 1 + (dims if self.name == "linear" else self.features)

    def map(self, x: np.ndarray) -> np.ndarray:
        """Features of all rows, a constant first."""
        if self.name == "linear":
            z = x
        else:
            frequencies, phases = self.basis(x.shape[1])
            z = np.sqrt(2.0 / self.features) * np.cos(x @ frequencies.T + phases)
        return np.concatenate([np.ones((len(x), 1)), z], axis=1)


def scale_gamma(rows: DataFrame) -> float:
    """The usual width: one over the number of dimensions times the variance of all their values."""
    values = rows.select(F.size("x").alias("d"), F.explode("x").alias("v"))
    d, variance = values.agg(F.max("d"), F.var_pop("v")).first()
    return 1.0 / (d * variance) if d and variance else 1.0


def stratified_folds(rows: DataFrame, folds: int, row_id: str, seed: int = 42) -> DataFrame:
    """Every class shuffled and dealt into folds whose sizes differ by one at most."""
    return grouped_ntile(rows, ["label"], [shuffle_key(F.col(row_id).cast("string"), seed)], folds, "fold")


def _batch(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return x, batch.column("fold").to_numpy(), batch.column("label").to_numpy()


def moments(rows: DataFrame, kernels: Sequence[Kernel], classes: Sequence[int], dims: int) -> DataFrame:
    """``Z'Z`` and ``Z'Y`` of every (kernel, fold), row by row."""
    known = np.array(classes)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, fold, label = _batch(batch, dims)
            targets = np.where(label[:, None] == known[None, :], 1.0, -1.0)
            for k, kernel in enumerate(kernels):
                z = kernel.map(x)
                for f in np.unique(fold).tolist():
                    mine = fold == f
                    sums = [z[mine].T @ z[mine], z[mine].T @ targets[mine]]
                    old = held.get((k, f))
                    held[k, f] = sums if old is None else [a + b for a, b in zip(old, sums)]
        for (k, f), (gram, cross) in held.items():
            n = len(gram)
            columns = [pa.array([k] * n, pa.int32()), pa.array([f] * n, pa.int32()), pa.array(range(n), pa.int32())]
            columns += [pa.array(list(m), pa.list_(pa.float64())) for m in (gram, cross)]
            yield pa.RecordBatch.from_arrays(columns, names=["kernel", "fold", "i", "gram", "cross"])

    def add(parts: pa.Table) -> pa.Table:
        i = parts.column("i").to_numpy()
        numbers, place = np.unique(i, return_inverse=True)
        sums = []
        for c in ("gram", "cross"):
            values = parts.column(c).combine_chunks().flatten().to_numpy().reshape(len(i), -1)
            total = np.zeros((len(numbers), values.shape[1]))
            np.add.at(total, place, values)
            sums.append(pa.array(list(total), pa.list_(pa.float64())))
        head = [pa.array([parts.column(c)[0].as_py()] * len(numbers), pa.int32()) for c in ("kernel", "fold")]
        return pa.table([*head, pa.array(numbers, pa.int32()), *sums], names=["kernel", "fold", "i", "gram", "cross"])

    return rows.mapInArrow(local, MATRIX).groupBy("kernel", "fold", F.expr(f"i div {ROWS_AT_ONCE}")).applyInArrow(add, MATRIX)


def held_out_weights(sums: DataFrame, penalties: Sequence[float]) -> DataFrame:
    """For every (kernel, fold), the weights of the fits on all other folds, one for each penalty."""

    def solve(parts: pa.Table) -> pa.Table:
        kernel = parts.column("kernel")[0].as_py()
        fold, i = parts.column("fold").to_numpy(), parts.column("i").to_numpy()
        size = int(i.max()) + 1
        grams, crosses = {}, {}
        for c, into in (("gram", grams), ("cross", crosses)):
            values = parts.column(c).combine_chunks().flatten().to_numpy().reshape(len(i), -1)
            for f in np.unique(fold).tolist():
                into[f] = np.zeros((size, values.shape[1]))
                into[f][i[fold == f]] = values[fold == f]
        gram, cross = sum(grams.values()), sum(crosses.values())
        out = []
        for f in grams:
            values, vectors = np.linalg.eigh(gram - grams[f])
            turned = vectors.T @ (cross - crosses[f])
            for c in penalties:
                weights = vectors @ (turned / (np.maximum(values, 0.0) + 1.0 / c)[:, None])
                out.append((kernel, f, float(c), weights.ravel().tolist()))
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["kernel", "fold", "c", "weights"])

    # A group holds a kernel's matrices, whose size the features fix.
    return sums.groupBy("kernel").applyInArrow(solve, WEIGHTS)


def grid_search(rows: DataFrame, row_id: str, kernels: Sequence[Kernel], penalties: Sequence[float], folds: int = 5, seed: int = 42) -> DataFrame:
    """Accuracy on held-out rows: (kernel, gamma, c, mean_accuracy, sd_accuracy, rank), one row per setting.

    ``rows`` holds ``row_id``, an integer ``label`` and ``x``, an array of numbers.  Rows with a null in them,
    or whose ``x`` is of another length than most, take no part.  Ties in accuracy share a rank.
    """
    whole = rows.select(row_id, "label", "x").where("label is not null and x is not null").where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    common = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return rows.sparkSession.createDataFrame([], "kernel string, gamma double, c double, mean_accuracy double, sd_accuracy double, rank int")
    dims = common["d"]
    whole = whole.where(F.size("x") == dims)
    classes = sorted(r["label"] for r in whole.select("label").distinct().collect())
    dealt = materialize(stratified_folds(whole, folds, row_id, seed).select("fold", "label", "x"))
    # One row of weights for each kernel, fold and penalty: fixed by the grid.
    solved = held_out_weights(moments(dealt, kernels, classes, dims), penalties).collect()
    weights: dict[int, list] = {}
    for r in solved:
        weights.setdefault(r["fold"], []).append((r["kernel"], r["c"], np.array(r["weights"]).reshape(-1, len(classes))))
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    known = np.array(classes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right: dict[tuple, list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, fold, label = _batch(batch, dims)
            mapped = [kernel.map(x) for kernel in kernels]
            for f in np.unique(fold).tolist():
                mine = fold == f
                for k, c, w in shared.value.get(f, ()):
                    best = known[(mapped[k][mine] @ w).argmax(axis=1)]
                    counts = right.setdefault((k, f, c), [0, 0])
                    counts[0] += int((best == label[mine]).sum())
                    counts[1] += int(mine.sum())
        if right:
            columns = [pa.array(v, t) for v, t in zip(zip(*((*key, *n) for key, n in right.items())), (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["kernel", "fold", "c", "correct", "n"])

    counted = dealt.mapInArrow(score, "kernel int, fold int, c double, correct long, n long")
    by_fold = counted.groupBy("kernel", "fold", "c").agg((F.sum("correct") / F.sum("n")).alias("accuracy"))
    means = by_fold.groupBy("kernel", "c").agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("sd_accuracy"))
    named = rows.sparkSession.createDataFrame([(i, k.name, float(k.gamma)) for i, k in enumerate(kernels)], "number int, name string, gamma double")
    joined = means.join(F.broadcast(named), F.col("kernel") == F.col("number"))
    # One row per setting: the rank is taken over an array of them.
    every = joined.agg(F.collect_list(F.struct(F.col("name").alias("kernel"), "gamma", "c", "mean_accuracy", "sd_accuracy")).alias("_g"))
    rank = lambda r: F.size(F.filter("_g", lambda o: o["mean_accuracy"] > r["mean_accuracy"])) + 1
    ranked = every.select(F.explode(F.transform("_g", lambda r: F.struct(r.alias("r"), rank(r).alias("rank")))).alias("s"))
    return ranked.select("s.r.*", "s.rank")
