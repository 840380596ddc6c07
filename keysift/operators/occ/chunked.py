"""Models of bounded size that meet bounded chunks of their table's rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysift.session import beside, same_address, settled


def dense(x: pa.ChunkedArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows with ``dims`` numbers and their matrix, a null in them as NaN."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(x), dims), False)
    values = pc.list_flatten(x.filter(fits))
    return np.flatnonzero(fits.to_numpy()), values.to_numpy().astype(float, copy=False).reshape(-1, dims)


def answered(
    rows: DataFrame, models: DataFrame, by: Sequence[str], answer: Callable[[pa.Table, pa.Table], pa.Array], name: str, chunk_rows: int
) -> DataFrame:
    """All rows with the double column ``name`` = ``answer(model rows, rows)``, chunk by chunk.

    ``models`` are the rows that make up each table's model; a table without any gets an empty model.
    Rows are dealt by what they hold themselves, so a repeated task deals them the same way, and a table
    of any size is as many groups as its rows fill chunks.
    """
    by = list(by)
    parts = settled(rows.groupBy(*by).agg(F.expr(f"count(*) div {chunk_rows} + 1").alias("_parts")))
    here, _ = beside(parts, by)
    chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))
    carried = [c for c in models.columns if c not in by]
    brought = models.join(here, same_address(by)).select(*[F.col(c).alias(f"_m{c}") for c in by], *carried, chunks.alias("_chunk"))
    dealt = rows.join(parts, by).select(*rows.columns, F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).alias("_chunk"))

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        return asked.drop_columns(["_chunk"]).append_column(name, answer(held, asked))

    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
    return brought.groupBy(*[f"_m{c}" for c in by], "_chunk").cogroup(dealt.groupBy(*by, "_chunk")).applyInArrow(run, schema)
