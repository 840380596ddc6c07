"""RBF one-class model: random Fourier features, a mean embedding per table and a quantile cut.

This is the Parzen-window limit of the one-class support vector machine with its ``nu`` cut: a row
scores its mean kernel value against the table, and the lowest ``nu`` share of training rows falls
below the threshold.  It is not the solution of the quadratic program.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.operators.ordering import grouped_order_statistics
from keysift.session import broadcast_if_small, materialize

FEATURE_SEED = 7


@dataclass(frozen=True)
class RBFParams:
    """``tol`` names the run as in iterative solvers; the closed form has no iterations to stop.

    ``margin`` is how far below the boundary a row is still accepted.
    """

    nu: float = 0.1
    gamma: float = 0.5
    tol: float = 1e-3
    features: int = 32
    margin: float = 0.0


def fourier_basis(params: RBFParams, width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(FEATURE_SEED)
    weights = rng.normal(0.0, np.sqrt(2 * params.gamma), size=(params.features, width))
    return weights, rng.uniform(0, 2 * np.pi, size=params.features)


def fourier_features(x: Column, params: RBFParams, width: int) -> Column:
    """``sqrt(2/R) cos(w.x + b)`` for every random frequency."""
    weights, phases = fourier_basis(params, width)
    scale = float(np.sqrt(2.0 / params.features))
    out = []
    for row, phase in zip(weights.tolist(), phases.tolist()):
        angle = F.lit(phase)
        for i, w in enumerate(row):
            angle = angle + F.get(x, F.lit(i)) * w
        out.append(F.cos(angle) * scale)
    return F.array(*out)


@dataclass
class RBFModel:
    by: list[str]
    params: RBFParams
    width: int
    embedding: DataFrame  # (by, _mean)
    threshold: DataFrame  # (by, threshold)

    def score(self, rows: DataFrame) -> DataFrame:
        """Add ``score`` (mean kernel value) and ``intercept`` (minus the table's threshold)."""
        fitted = self.embedding.join(self.threshold, self.by)
        z = fourier_features(F.col("x"), self.params, self.width)
        joined = rows.withColumn("_z", z).join(broadcast_if_small(fitted), self.by)
        return joined.withColumn("score", _inner("_z", "_mean")).withColumn("intercept", -F.col("threshold")).drop("_z", "_mean", "threshold")

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.score(rows).withColumn("prediction", margin_prediction(F.col("score"), F.col("intercept"), self.params.margin))


def margin_prediction(score: Column, intercept: Column, tolerance: float) -> Column:
    """1 where the score is above the boundary less the tolerance."""
    return F.when(score + intercept > -tolerance, 1).otherwise(-1)


def _inner(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)


def fit(rows: DataFrame, by: Sequence[str], params: RBFParams, width: int) -> RBFModel:
    by = list(by)
    z = fourier_features(F.col("x"), params, width)
    # One column per feature: all means come from a single aggregation with a map-side combine.
    featured = rows.select(*by, "x", z.alias("_z"))
    means = featured.groupBy(*by).agg(*[F.avg(F.get(F.col("_z"), F.lit(i))).alias(f"_f{i}") for i in range(params.features)])
    embedding = materialize(means.select(*by, F.array(*[f"_f{i}" for i in range(params.features)]).alias("_mean")))
    scored = featured.join(broadcast_if_small(embedding), by).withColumn("score", _inner("_z", "_mean"))
    threshold = grouped_order_statistics(scored.select(*by, "score"), by, "score", params.nu, "threshold")
    return RBFModel(by, params, width, embedding, materialize(threshold))


def support_ratio(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of training rows at or below the boundary."""
    return scored.groupBy(*by).agg((F.count_if(F.col("score") + F.col("intercept") <= 0) / F.count("*")).alias("support_ratio"))
