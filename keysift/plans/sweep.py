"""Training runs, parameter grids, one-job sweeps and cross-validation."""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.operators import bloom
from keysift.operators.occ import rp
from keysift.operators.occ.registry import WIDTH, family, key_features
from keysift.operators.ordering import grouped_ntile
from keysift.plans import evaluation, full_sweep
from keysift.session import materialize
from keysift.sources.generators import shuffle_key

BY = ["table_id"]


def linspace(low: float, high: float, steps: int) -> list[float]:
    return np.linspace(low, high, steps).tolist()


def logspace(low: float, high: float, steps: int) -> list[float]:
    return np.logspace(low, high, steps).tolist()


def with_grid(rows: DataFrame, **axes: Sequence) -> DataFrame:
    """Every row with every combination of the axes' values."""
    for name, values in axes.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows


def train_all(keys: DataFrame, name: str, params: dict):
    """Fit one model per table in one run; returns the model and the seconds it took."""
    start = time.monotonic()
    model = family(name).fit(keys, BY, params)
    return model, time.monotonic() - start


def run(keys: DataFrame, name: str, params: dict, error_rate: float, skip: int = 1, truth: str = "any") -> DataFrame:
    """Fit, back up and evaluate one configuration; one row: parameters, rejects, counters, seconds.

    A configuration of the sweep's family is a sweep of one.
    """
    start = time.monotonic()
    if name == "epsilon" and params.get("agg_abs") is None:
        swept, rejects = full_sweep.single_run(keys, rp.RPParams(**params), error_rate, truth, skip)
        counters = materialize(swept.select("fpr", *evaluation.COUNTERS, "bfsize"))
        elapsed = time.monotonic() - start
    else:
        model, _ = train_all(keys, name, params)
        filters, rejects = evaluation.backup_filters(keys, model, BY, error_rate)
        counters = materialize(evaluation.evaluate(keys, model, filters, truth, skip))
        elapsed = time.monotonic() - start
        counters = counters.withColumn("bfsize", bloom.total_filter_bytes(filters.params).scalar())
    by_table = rejects.agg(F.map_from_entries(F.collect_list(F.struct("table_id", "rejects")))).scalar()
    record = counters.withColumn("error_train", by_table)
    for key, value in params.items():
        record = record.withColumn(key, F.lit(value))
    return record.withColumn("family", F.lit(name)).withColumn("elapsed", F.lit(elapsed))


def kfold(keys: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """Shuffle each table and deal it into near-equal folds."""
    return grouped_ntile(keys, BY, [shuffle_key(F.col("key"), seed)], folds, "fold")


def training_rows(folded: DataFrame, folds: int) -> DataFrame:
    """Rows per training set: ``fold`` becomes the fold that is held out."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    return folded.withColumn("fold", F.explode(others))


def validation_rejects(keys: DataFrame, folds: int, params: rp.RPParams, seed: int = 42) -> DataFrame:
    """Held-out keys and how many of them the model of the other folds rejects, per fold and table."""
    by = ["fold", "table_id"]
    folded = materialize(kfold(keys, folds, seed))
    model = rp.fit(training_rows(folded, folds), by, params, key_features, WIDTH)
    answered = model.accept(model.prepare(folded))
    return answered.groupBy(*by).agg(F.count("*").alias("held_out"), F.count_if(~F.col("accepted")).alias("rejects"))
