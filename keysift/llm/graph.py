"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.tables import written


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) of every node that has an edge; ``edges`` holds ``a`` and ``b``.

    Every round ties all neighbours of a node to the least of them, first the larger ones, then the
    smaller; path lengths shrink geometrically.  Repeated pairs go once a round, after the second half.  Hot nodes meet partial minima and joins that can be
    split.  Self loops, repeated edges and edges with a null end are ignored.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = written(pairs, "edges")
    before = _mark(pairs)
    while before[0]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(lower.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        after = _mark(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))


def tree_roots(pointers: DataFrame) -> DataFrame:
    """``node`` and ``up``, the root of its tree, of every ``node`` that points to another one, ``up``.

    Pointers form trees: a node has one at most, and none leads back.  Every round doubles the way that each has gone.
    """
    paths = written(pointers.select("node", "up"), "pointers")
    moved = 1
    while moved:
        above = paths.select(F.col("node").alias("up"), F.col("up").alias("further"))
        stepped = paths.join(above, "up", "left").select("node", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved"))
        stepped = written(stepped, "pointers")
        moved = stepped.where("moved").limit(1).count()
        paths = stepped.select("node", "up")
    return paths
