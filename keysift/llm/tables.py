"""Reading documents, shared scratch tables, and Arrow batches cut to a bounded number of text bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.session import scratch_path

# Text bytes that a Python worker holds as objects at one time; one longer text is a slice of its own.
SLICE_BYTES = 2 * 1024 * 1024


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The whole ``documents`` table of a data folder, only the columns named."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns or ("doc_id", "text"))


def text_only(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of a table that may hold other columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, which cuts its lineage for good."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column ``text`` of each holds at most ``limit`` bytes, or one row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("text").cast(pa.binary())).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if len(sizes) > start:
            yield batch.slice(start)


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    """The texts of a batch as UTF-8 bytes."""
    return batch.column("text").cast(pa.binary()).to_pylist()


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, and the folder's path in it."""
    return fs.FileSystem.from_uri(folder) if folder.startswith("file:") or "://" in folder else (fs.LocalFileSystem(), folder)
