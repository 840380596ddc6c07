"""One-class model families by name, all with the same contract."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.functions.text import parse_key
from keysift.operators import overlap, scaling
from keysift.operators.occ import gmm, iforest, rbf, rp, svm_primal
from keysift.operators.ordering import grouped_row_number
from keysift.plans.evaluation import AlwaysNegative, Classifier
from keysift.session import broadcast_if_small, materialize

WIDTH = 2  # features of a parsed key


def key_features() -> Column:
    return parse_key(F.col("key"))


@dataclass(frozen=True)
class Family:
    """``fit`` takes keys, the table columns and parameters; ``size`` reports bits per table."""

    name: str
    fit: Callable[[DataFrame, list[str], dict], Classifier]
    size: Callable[[Classifier], DataFrame | None]
    grid: Callable[[], Iterable[dict]]
    sample: dict

    def params_text(self, params: dict) -> str:
        return "_".join(str(v) for v in params.values())


@dataclass
class ExactModel:
    """A table's rows themselves; accepts what it has seen."""

    by: list[str]
    rows: DataFrame
    features: Callable[[], Column]

    def prepare(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_row", self.features())

    def accept(self, rows: DataFrame) -> DataFrame:
        seen = self.rows.select(*self.by, "_row").distinct().withColumn("_seen", F.lit(True))
        joined = rows.join(seen, [*self.by, "_row"], "left")
        return joined.withColumn("accepted", F.coalesce(F.col("_seen"), F.lit(False))).drop("_seen")


@dataclass
class ScaledRBF:
    """The RBF model on features scaled by the asked table's own scaler."""

    by: list[str]
    scalers: DataFrame
    model: rbf.RBFModel

    def prepare(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_x", key_features())

    def accept(self, rows: DataFrame) -> DataFrame:
        scaled = scaling.apply_scaler(rows.withColumn("x", F.col("_x")), self.scalers, self.by)
        answered = self.model.predict(scaled)
        return answered.withColumn("accepted", F.col("prediction") == 1).drop("x", "score", "intercept", "prediction")


@dataclass
class ForestModel:
    by: list[str]
    nodes: DataFrame
    samples: DataFrame
    trees: int

    def prepare(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_x", key_features())

    def accept(self, rows: DataFrame) -> DataFrame:
        asked = rows.withColumn("x", F.col("_x"))
        answered = iforest.score(asked, self.nodes, self.by, self.trees, self.samples)
        return answered.withColumn("accepted", F.coalesce(iforest.predict(F.col("score")) == 1, F.lit(False))).drop("x", "score")


def fit_rp(keys: DataFrame, by: list[str], params: dict) -> rp.RPModel:
    return rp.fit(keys, by, rp.RPParams(**params), key_features, WIDTH)


def rp_axes() -> dict[str, tuple]:
    """The axes of the random-projection family's grid."""
    return {
        "dims": tuple(int(d) for d in np.logspace(math.log10(2), math.log10(256), 10)), "epsilons": tuple(np.logspace(-4, -1, 10).tolist()),
        "aggs": tuple(np.linspace(0.8, 1.0, 3).tolist()), "boxes": (0.0, *np.logspace(-4, -1, 9).tolist()),
    }


def rp_grid() -> Iterable[dict]:
    for d, e, a, b in itertools.product(*rp_axes().values()):
        yield {"D": d, "epsilon": e, "agg_thr": a, "box_thr": b}


def fit_rbf(keys: DataFrame, by: list[str], params: dict) -> ScaledRBF:
    rows = keys.select(*by, key_features().alias("x"))
    scalers = scaling.fit_standard(rows, by)
    return ScaledRBF(by, scalers, rbf.fit(scaling.apply_scaler(rows, scalers, by), by, rbf.RBFParams(**params), WIDTH))


@dataclass
class ScaledSVM:
    """The primal machine on features scaled by the asked table's own scaler."""

    by: list[str]
    scalers: DataFrame
    model: svm_primal.SVMModel

    def prepare(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_x", key_features())

    def accept(self, rows: DataFrame) -> DataFrame:
        answered = self.model.predict(scaling.apply_scaler(rows.withColumn("x", F.col("_x")), self.scalers, self.by))
        return answered.select(*rows.columns, F.coalesce(F.col("prediction") == 1, F.lit(False)).alias("accepted"))


def fit_svm(keys: DataFrame, by: list[str], params: dict) -> ScaledSVM:
    rows = keys.select(*by, key_features().alias("x"))
    scalers = scaling.fit_standard(rows, by)
    return ScaledSVM(by, scalers, svm_primal.fit(scaling.apply_scaler(rows, scalers, by), by, svm_primal.SVMParams(**params), WIDTH))


def svm_size(model: ScaledSVM) -> DataFrame:
    """Bits of the weights and of the boundary."""
    return model.model.threshold.select(*model.by, F.lit((model.model.params.features + 1) * 64).cast("bigint").alias("bits"))


def rbf_grid() -> Iterable[dict]:
    """Rejected share, kernel width and tolerance of the RBF family's grid."""
    for nu, gamma, tol in itertools.product(np.logspace(-3, 0, 4), np.logspace(-1, 3, 3), [0.001, 0.01, 0.1, 1.0]):
        yield {"nu": float(nu), "gamma": float(gamma), "tol": tol}


def fit_forest(keys: DataFrame, by: list[str], params: dict) -> ForestModel:
    trees, sample_rows = params.get("trees", 100), params.get("sample_rows", iforest.SAMPLE_ROWS)
    # Copies of a key get numbers of their own, the same ones however the rows are partitioned.
    rows = grouped_row_number(keys.select(*by, "key"), by, ["key"], "_id").select(*by, "_id", key_features().alias("x"))
    samples = materialize(iforest.tree_samples(rows, by, "_id", trees, sample_rows))
    return ForestModel(by, materialize(iforest.grow_trees(samples, by, "_id")), samples, trees)


@dataclass
class MixtureModel:
    """Accepts rows whose log-likelihood lies within ``factor`` deviations of the table's mean."""

    by: list[str]
    scalers: DataFrame
    components: DataFrame
    band: DataFrame
    factor: float

    def prepare(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_x", key_features())

    def _scored(self, rows: DataFrame) -> DataFrame:
        scaled = scaling.apply_scaler(rows.withColumn("x", F.col("_x")), self.scalers, self.by)
        x = F.col("x")
        return gmm.with_log_likelihood(scaled.withColumns({"x0": x[0], "x1": x[1]}), self.components, self.by).drop("x", "x0", "x1", "_mix", "_logs")

    def accept(self, rows: DataFrame) -> DataFrame:
        joined = self._scored(rows).join(broadcast_if_small(self.band), self.by)
        inside = gmm.band_prediction(F.col("ll"), F.col("mean"), F.col("sigma"), self.factor, 1e-12) == 1
        return joined.withColumn("accepted", F.coalesce(inside, F.lit(False))).select(*rows.columns, "accepted")


def fit_mixture(keys: DataFrame, by: list[str], params: dict) -> MixtureModel:
    rows = keys.select(*by, key_features().alias("x"))
    scalers = scaling.fit_minmax(rows, by)
    x = F.col("x")
    scaled = materialize(scaling.apply_scaler(rows, scalers, by).select(*by, x[0].alias("x0"), x[1].alias("x1")))
    components, _ = gmm.fit(scaled, by, params.get("max_iter", 100), params.get("tolerance", 1e-3))
    band = materialize(gmm.likelihood_band(gmm.with_log_likelihood(scaled, components, by), by))
    return MixtureModel(by, scalers, components, band, params["factor"])


def mixture_size(model: MixtureModel) -> DataFrame:
    """Bits of the components' six numbers and of the band."""
    return model.components.groupBy(*model.by).agg(((F.count("*") * 6 + 2) * 64).alias("bits"))


def fit_kernel_rp(keys: DataFrame, by: list[str], params: dict) -> rp.RPModel:
    """Random projections of kernel values: the directions stand in for the second argument of the kernel."""
    kernel = {k: params[k] for k in ("kernel", "gamma", "offset", "degree") if k in params}
    plain = rp.RPParams(**{k: v for k, v in params.items() if k not in kernel})
    directions = rp.unit_planes(plain.D, WIDTH)
    return rp.fit(keys, by, plain, lambda: rp.kernel_project(key_features(), directions, **kernel), plain.D)


def kernel_rp_size(model: rp.RPModel) -> DataFrame:
    return rp.model_bits(model.intervals, model.by, model.params.D, model.params.D).select(*model.by, "bits")


def fit_exact(features: Callable[[], Column]):
    def fit(keys: DataFrame, by: list[str], params: dict) -> ExactModel:
        return ExactModel(by, keys.select(*by, features().alias("_row")), features)

    return fit


def exact_size(model: ExactModel) -> DataFrame:
    """Entries per table."""
    return model.rows.distinct().groupBy(*model.by).agg(F.count("*").alias("bits"))


def rbf_size(model: ScaledRBF) -> DataFrame:
    """Bits of the embedding and its threshold."""
    return model.model.threshold.select(*model.by, F.lit((model.model.params.features + 1) * 64).cast("bigint").alias("bits"))


def forest_size(model: ForestModel) -> DataFrame:
    return model.nodes.groupBy(*model.by).agg((F.count("*") * (32 + 64 + 64)).alias("bits"))


def rp_size(model: rp.RPModel) -> DataFrame:
    return rp.model_bits(model.intervals, model.by, model.params.D, WIDTH).select(*model.by, "bits")


def single() -> Iterable[dict]:
    yield {}


FAMILIES: dict[str, Family] = {}


def register_family(family: Family) -> None:
    FAMILIES[family.name] = family


def family(name: str) -> Family:
    if name not in FAMILIES:
        raise ValueError(f"unknown model family {name!r}; known: {sorted(FAMILIES)}")
    return FAMILIES[name]


register_family(Family("epsilon", fit_rp, rp_size, rp_grid, {"D": 9, "epsilon": 1e-2, "agg_thr": 0.9, "box_thr": 1e-2}))
for _name in ("svmsimple", "libsvmsch"):
    register_family(Family(_name, fit_rbf, rbf_size, rbf_grid, {"nu": 0.1, "gamma": 0.5, "tol": 1e-3}))
register_family(Family("svmprimal", fit_svm, svm_size, rbf_grid, {"nu": 0.1, "gamma": 0.5, "tol": 1e-2}))
register_family(Family("isolationforest", fit_forest, forest_size, single, {"trees": 100, "sample_rows": iforest.SAMPLE_ROWS}))
register_family(Family("gaussianmixture", fit_mixture, mixture_size, single, {"factor": 2.0}))
register_family(Family("kernelepsilon", fit_kernel_rp, kernel_rp_size, single, {"D": 9, "epsilon": 1e-2, "agg_thr": 0.9, "box_thr": 1e-2, "kernel": "p"}))
register_family(Family("np", fit_exact(key_features), exact_size, single, {}))
register_family(Family("dic", fit_exact(lambda: overlap.row_text(key_features())), exact_size, single, {}))
register_family(Family("alwaysNegative", lambda keys, by, params: AlwaysNegative(), lambda model: None, single, {}))
