"""Isolation forests, one per table.

Trees are grown on samples of ``sample_rows`` rows (a parameter of the family, 256 as a rule), so
growing one tree is a bounded group; chunks of a table's rows meet the table's forest and
walk its trees as flat arrays, all rows a step at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keysift.operators.occ import chunked
from keysift.session import broadcast_if_small, settled

SAMPLE_ROWS = 256  # rows per tree unless the family's parameters say otherwise
SEED = 0


def _unit(*columns) -> "F.Column":
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def tree_samples(rows: DataFrame, by: Sequence[str], row_id: str, trees: int, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """An exact sample of up to ``sample_rows`` rows per (table, tree): the rows with the smallest seeded hash.

    ``row_id`` must tell the rows of a table apart, or copies would enter a group together.

    A hash threshold at three times the wanted share drops nearly all rows map-side, before the
    sample is cut to size in groups of a few hundred rows.
    """
    by = list(by)
    sizes = settled(rows.groupBy(*by).agg(F.count("*").alias("_n")))
    # Only the trees whose threshold a row passes are spread to rows of their own.
    draw = lambda tree: _unit(F.col(row_id), tree, F.lit(SEED))
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    passed = F.filter(every, lambda tree: draw(tree) * F.col("_n") < 3 * sample_rows)
    near = rows.join(sizes, by).withColumn("tree", F.explode(passed)).withColumn("_u", draw(F.col("tree")))
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "tree").orderBy("_u", row_id)))
    return ranked.where(F.col("_r") <= sample_rows).select(*by, "tree", row_id, "x")


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    deep = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, deep))


def grow_trees(samples: DataFrame, by: Sequence[str], row_id: str) -> DataFrame:
    """One row per node: split feature and value, or a leaf with its remaining path length."""
    by = list(by)

    def grow(pdf):
        import pandas as pd

        pdf = pdf.sort_values(row_id)
        x = np.stack(pdf["x"].to_numpy())
        head = [pdf[c].iloc[0] for c in by] + [int(pdf["tree"].iloc[0])]
        rng = np.random.RandomState(zlib.crc32(repr([str(h) for h in head]).encode()))
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        nodes, todo = [], [(1, np.arange(len(x)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            open_features = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or len(open_features) == 0:
                nodes.append((node, -1, 0.0, depth + float(average_path(len(rows)))))
                continue
            feature = int(rng.choice(open_features))
            value = float(rng.uniform(low[feature], high[feature]))
            nodes.append((node, feature, value, 0.0))
            left = x[rows, feature] <= value
            todo += [(2 * node, rows[left], depth + 1), (2 * node + 1, rows[~left], depth + 1)]
        out = pd.DataFrame(nodes, columns=["node", "feature", "value", "path"])
        for name, value in zip([*by, "tree"], head):
            out[name] = value
        return out

    types = dict(samples.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", tree int, node long, feature int, value double, path double"
    columns = [*by, "tree", "node", "feature", "value", "path"]
    grown = samples.groupBy(*by, "tree").applyInPandas(lambda pdf: grow(pdf)[columns], schema)
    return grown


# Rows of a table that are scored together.
CHUNK_ROWS = 1 << 17


class Tree:
    """A tree as flat arrays by node number: the root is 1, the children of ``i`` are ``2i`` and ``2i + 1``."""

    def __init__(self, nodes: np.ndarray, feature: np.ndarray, value: np.ndarray, path: np.ndarray):
        size = int(nodes.max()) + 1
        self.feature, self.value, self.path = np.full(size, -1, np.int32), np.zeros(size), np.zeros(size)
        self.feature[nodes], self.value[nodes], self.path[nodes] = feature, value, path

    def paths(self, columns: list[np.ndarray]) -> np.ndarray:
        """The depth at which every row ends; all rows take a step at a time, those at a leaf stay."""
        at = np.ones(len(columns[0]), np.int64)
        moving = np.arange(len(at))
        while len(moving):
            feature = self.feature[at[moving]]
            moving, feature = moving[feature >= 0], feature[feature >= 0]
            here = at[moving]
            right = np.zeros(len(moving), bool)
            for f in np.unique(feature):
                mine = feature == f
                right[mine] = columns[f][moving[mine]] > self.value[here[mine]]
            at[moving] = 2 * here + right
        return self.path[at]


def score(rows: DataFrame, nodes: DataFrame, by: Sequence[str], trees: int, sampled: DataFrame) -> DataFrame:
    """All rows with ``score`` = ``2^(-E[path] / c(sample))``; null where a feature is null or the table has no forest.

    A table's forest, bounded by its trees and their samples, meets bounded chunks of the table's rows.
    """
    by = list(by)
    sizes = sampled.groupBy(*by, "tree").agg(F.count("*").alias("_n")).groupBy(*by).agg(F.max("_n").alias("_n"))
    n = F.col("_n")
    expected = F.when(n <= 2, 1.0).otherwise(2.0 * (F.log(n - 1.0) + float(np.euler_gamma)) - 2.0 * (n - 1.0) / n)
    packed = nodes.groupBy(*by, "tree").agg(F.collect_list(F.struct("node", "feature", "value", "path")).alias("_t"))
    packed = packed.select(*by, "tree", *[F.col(f"_t.{c}").alias(c) for c in ("node", "feature", "value", "path")])
    forests = packed.join(broadcast_if_small(sizes.select(*by, expected.alias("_c"))), by)

    def walk(held: pa.Table, asked: pa.Table) -> pa.Array:
        x = asked.column("x").combine_chunks()
        lists = x.flatten().to_numpy(zero_copy_only=False).astype(float)
        width = len(lists) // max(1, len(x))
        if not (held.num_rows and width) or x.null_count:
            return pa.nulls(len(x), pa.float64())
        columns = list(np.ascontiguousarray(lists.reshape(-1, width).T))
        parts = [held.column(c).combine_chunks() for c in ("node", "feature", "value", "path")]
        total = np.zeros(len(x))
        for i in np.argsort(held.column("tree").to_numpy()):
            total += Tree(*(p[i].values.to_numpy() for p in parts)).paths(columns)
        score = np.power(2.0, -(total / trees) / held.column("_c")[0].as_py())
        return pa.array(score, mask=np.isnan(lists).reshape(-1, width).any(axis=1))

    return chunked.answered(rows, forests, by, walk, "score", CHUNK_ROWS)


def predict(score_column):
    """1 for rows that are not isolated faster than an average search."""
    return F.when(score_column > 0.5, -1).otherwise(1)
