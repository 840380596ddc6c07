"""Learned-filter lookups: a per-table classifier first, the table's backup filter second.

Which table stops a probe is known without asking any filter: the first table that truly holds the
key, because a table's classifier or its backup filter accepts every key of the table.  Probes are
therefore collapsed to distinct keys with weights before any table is asked, and asking happens
map-side, table by table in groups whose filters fit a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.operators import bloom
from keysift.operators.bloom import FilterSet
from keysift.session import materialize


class Classifier(Protocol):
    """A fitted one-class model per table, asked about keys."""

    def prepare(self, rows: DataFrame) -> DataFrame:
        """Add the feature columns the model needs, computed from ``key`` alone."""

    def accept(self, rows: DataFrame) -> DataFrame:
        """Add the boolean ``accepted`` for the model addressed by the row's table columns."""


class AlwaysNegative:
    """The baseline without a classifier: every key falls to the filter."""

    def prepare(self, rows: DataFrame) -> DataFrame:
        return rows

    def accept(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("accepted", F.lit(False))


def own_predictions(keys: DataFrame, classifier: Classifier) -> DataFrame:
    """The answer of every table's model on the table's own keys."""
    return classifier.accept(classifier.prepare(keys))


def backup_filters(
    keys: DataFrame, classifier: Classifier, by: list[str], error_rate: float, share: int = 1, floor_one: bool = False
) -> tuple[FilterSet, DataFrame]:
    """Filters over the keys their own model rejects, and the reject counts per table.

    ``share`` divides the capacity (5 gives deliberately over-full filters); ``floor_one`` reports
    at least one reject per table, as the older records do.
    """
    # The rejected keys are written once; a table without any has a count of zero.
    refused = materialize(own_predictions(keys, classifier).where(~F.col("accepted")).select(*by, "key"))
    counted = refused.groupBy(*by).agg(F.count("*").alias("rejects"))
    rejects = keys.select(*by).distinct().join(counted, by, "left").select(*by, F.coalesce("rejects", F.lit(0).cast("bigint")).alias("rejects"))
    rejects = materialize(rejects)
    capacities = rejects.withColumn("capacity", F.col("rejects") if share == 1 else F.col("rejects") / share)
    params = bloom.size_filters(capacities, by, error_rate)
    filters = bloom.build_filters(refused, params, by, error_rate)
    if floor_one:
        rejects = rejects.withColumn("rejects", F.greatest("rejects", F.lit(1).cast("bigint")))
    return filters, rejects


def two_stage_parts(pairs: DataFrame, classifier: Classifier, filters: FilterSet) -> Iterator[DataFrame]:
    """Add ``source`` ('c', 'bf' or NULL) to (key, table) rows that carry features and digests.

    Every row comes back once, in some part, whatever the filters' size.
    """
    plain = [c for c in pairs.columns if not c.startswith("_")]
    source = F.when(F.col("accepted"), "c").when(F.col("_maybe"), "bf").alias("source")
    for part in bloom.asked_parts(classifier.accept(pairs), filters):
        yield part.select(*plain, source)


def two_stage(pairs: DataFrame, classifier: Classifier, filters: FilterSet) -> DataFrame:
    """All parts of ``two_stage_parts`` together."""
    return reduce(DataFrame.unionByName, two_stage_parts(pairs, classifier, filters))


def probe_stops(keys: DataFrame, truth: str, skip: int = 1) -> DataFrame:
    """Distinct keys with the table their probes stop at and the number ``n`` of probes.

    ``truth='any'`` stops at the first table that holds the key, ``truth='owner'`` at the table
    the probe was taken from.  With ``skip`` every ``skip``-th key of each table is a probe.
    """
    sampled = F.lit(1) if skip == 1 else (F.col("pos") % skip == 0).cast("int")
    weighted = keys.select("key", "table_id", sampled.cast("bigint").alias("_s"))
    if truth == "any":
        grouped = weighted.groupBy("key").agg(F.min("table_id").alias("stop"), F.sum("_s").alias("n"))
    elif truth == "owner":
        grouped = weighted.groupBy("key", F.col("table_id").alias("stop")).agg(F.sum("_s").alias("n"))
    else:
        raise ValueError("truth is 'any' or 'owner'")
    return grouped.where("n > 0")


def asked_pairs(stops: DataFrame, classifier: Classifier, filters: FilterSet) -> DataFrame:
    """Every (key, table) that is asked: ordinals up to the stop, streamed inside one stage."""
    prepared = bloom.with_digests(classifier.prepare(stops), filters)
    return prepared.withColumn("table_id", F.explode(F.sequence(F.lit(0), F.col("stop"))))


COUNTERS = [
    "truepositive_c", "truepositive_bf", "truepositive", "falsepositive_c", "falsepositive_bf", "falsepositive", "truenegative",
]


def false_positive_rate(fp: Column, tn: Column) -> Column:
    return F.try_divide(fp.cast("double"), (fp + tn).cast("double"))


def evaluate(
    keys: DataFrame, classifier: Classifier, filters: FilterSet, truth: str = "any", skip: int = 1,
    config: str | None = None, configs: list[int] | None = None,
) -> DataFrame:
    """Counters of the first-match lookup, split by the stage that answered.

    A table that denies its own key raises: the filters then do not belong to the classifier.
    With a ``config`` column, ``configs`` lists the configurations and all of them are evaluated.
    """
    every = F.explode(F.array(*[F.lit(c) for c in configs])).alias(config) if config else None
    extra = [config] if config else []
    stops = probe_stops(keys, truth, skip)
    pairs = asked_pairs(stops, classifier, filters)
    at_stop, before = F.col("table_id") == F.col("stop"), F.col("table_id") < F.col("stop")
    by_c, by_bf, yes = F.col("source") == "c", F.col("source") == "bf", F.col("source").isNotNull()
    sums = [
        F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint").alias(name)
        for name, condition in [
            ("truepositive_c", at_stop & by_c), ("truepositive_bf", at_stop & by_bf), ("truepositive", at_stop & yes),
            ("falsepositive_c", before & by_c), ("falsepositive_bf", before & by_bf), ("falsepositive", before & yes),
        ]
    ]
    nothing = [F.lit(0).cast("bigint").alias("asked"), F.lit(0).cast("bigint").alias("probes")]
    # One part after another: only its counters leave a part, and only one group of filters is out at a time.
    parts = [p.groupBy(*extra).agg(*sums, *nothing) for p in two_stage_parts(pairs.select("*", every) if config else pairs, classifier, filters)]
    counted = reduce(DataFrame.unionByName, parts if len(parts) == 1 else map(materialize, parts))
    totals = stops.agg(F.sum(F.col("n") * F.col("stop")).cast("bigint").alias("asked"), F.sum("n").alias("probes"))
    totals = totals.select(
        *([every] if config else []), *[F.lit(0).cast("bigint").alias(c) for c in COUNTERS[:-1]], "asked", "probes"
    )
    summed = counted.unionByName(totals).groupBy(*extra).agg(*[F.sum(c).alias(c) for c in [*COUNTERS[:-1], "asked", "probes"]])
    denied = F.col("truepositive") != F.col("probes")
    rate = false_positive_rate(F.col("falsepositive"), F.col("truenegative"))
    return summed.withColumn("truenegative", F.col("asked") - F.col("falsepositive")).select(
        *extra,
        F.when(denied, F.raise_error(F.lit("a table denies its own key")).cast("double")).otherwise(rate).alias("fpr"),
        *COUNTERS,
    )


def denied_keys(keys: DataFrame, classifier: Classifier, filters: FilterSet) -> DataFrame:
    """Keys whose own table answers no.  Empty for filters that belong to the classifier."""
    prepared = bloom.with_digests(classifier.prepare(keys.select("table_id", "key").distinct()), filters)
    yes = two_stage(prepared, classifier, filters).where("source IS NOT NULL").select("table_id", "key")
    return keys.select("table_id", "key").distinct().join(yes, ["table_id", "key"], "left_anti")
