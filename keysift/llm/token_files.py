"""Token ids in Arrow files of fixed-size-list batches.

The ids of all documents, in ascending order of ``doc_id``, are one sequence, cut into files by
ranges of ``doc_id``.  A file holds equal-length rows of ids with a mask that is false beyond the
last id; row ``r`` and column ``c`` hold the file's id ``r * LENGTH + c``, so a document is a slice of
a batch's value buffer, read without a copy.  A second file beside it lists the documents with their
starts.  Files are written below a shared folder by the tasks that made them; the manifest names the
files of the attempts that counted, so a lost or repeated task does no harm.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.tables import open_folder, raw_texts, slices, text_only, written
from keysift.llm.vocab import shipped, word_encoder

# Ids of one row, and rows of one record batch.
LENGTH = 2048
BATCH_ROWS = 256

MANIFEST = "part int, path string, n_docs long, n_tokens long"


class SequenceWriter:
    """Writes ids into rows of equal length, a batch at a time."""

    def __init__(self, files: fs.FileSystem, path: str, dtype: np.dtype, length: int):
        self.length, self.dtype = length, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = files.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= self.length * BATCH_ROWS:
            self._flush(self.n_held - self.n_held % (self.length * BATCH_ROWS))

    def _flush(self, count: int) -> None:
        """Write the first ``count`` held ids; beyond the last id rows are filled up with zeros."""
        values = np.concatenate([*self.held, np.zeros(0, self.dtype)])
        self.held, self.n_held = [values[count:]], len(values[count:])
        for start in range(0, count, self.length * BATCH_ROWS):
            ids = values[start : min(start + self.length * BATCH_ROWS, count)]
            rows = -(-len(ids) // self.length)
            full = np.zeros(rows * self.length, self.dtype)
            full[: len(ids)] = ids
            mask = np.arange(len(full)) < len(ids)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            self._flush(self.n_held)
        self.writer.close()
        self.sink.close()


class SequenceReader:
    """Random access to rows, masks and runs of ids of one file, without copies where the file system maps memory."""

    def __init__(self, files: fs.FileSystem, path: str):
        source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.number, self.values = -1, np.zeros(0)

    def _batch(self, number: int) -> np.ndarray:
        if number != self.number:
            self.values = self.file.get_batch(number).column("ids").flatten().to_numpy(zero_copy_only=True)
            self.number = number
        return self.values

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one row."""
        batch = self.file.get_batch(row // BATCH_ROWS)
        at = row % BATCH_ROWS
        mask = batch.column("mask")[at].values.to_numpy(zero_copy_only=False)
        return self._batch(row // BATCH_ROWS)[at * self.length : (at + 1) * self.length], mask

    def run(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, as one view per batch."""
        size = self.length * BATCH_ROWS
        while count > 0:
            values = self._batch(start // size)
            at = start % size
            view = values[at : min(at + count, size)]
            yield view
            start, count = start + len(view), count - len(view)


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int | None, length: int = LENGTH) -> DataFrame:
    """Encode all texts by the JSON tokenizer ``path`` and write them below ``folder``; returns the manifest.

    ``end_id`` is put after each document.  Documents are written in ascending order of ``doc_id``, null
    first; rows that share an id keep the order of the table.  Null and empty texts have only the end id.
    An empty table gives no files.  Other columns are not read.
    """
    spark = docs.sparkSession
    vocabulary = shipped(spark, path)
    # The row's place in the table parts documents that share an id, so that a range can be cut among them.
    texts = text_only(docs).withColumn("place", F.monotonically_increasing_id())
    ranged = texts.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = word_encoder(vocabulary.value)
        part = TaskContext.get().partitionId()
        target, root = open_folder(folder)
        target.create_dir(root, recursive=True)
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        writer, n_docs, starts = None, 0, None
        end = np.array([] if end_id is None else [end_id], encoder.dtype)
        for piece in slices(batches):
            if writer is None:
                writer = SequenceWriter(target, f"{name}.ids.arrow", encoder.dtype, length)
                listed = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
                sink = target.open_output_stream(f"{name}.docs.arrow")
                starts = pa.ipc.new_file(sink, listed)
            first, sizes = writer.n_tokens, []
            for ids in encoder.encode(raw_texts(piece)):
                writer.add(ids)
                writer.add(end)
                sizes.append(len(ids) + len(end))
            places = first + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            starts.write_batch(pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(places), pa.array(sizes, pa.int64())], schema=listed))
            n_docs += piece.num_rows
        if writer is not None:
            writer.close()
            starts.close()
            sink.close()
            columns = [pa.array([part], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([writer.n_tokens], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "path", "n_docs", "n_tokens"])

    return written(ranged.select("doc_id", "text").mapInArrow(run, MANIFEST), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the files that a manifest names: ``doc_id``, ``start`` in the whole sequence, ``n_tokens``, ``ids_crc32``.

    ``ids_crc32`` is over the document's ids as little-endian unsigned 32-bit integers.
    """
    # One row per file; sizes alone come to the driver, to lay the files end to end.
    parts = sorted(manifest.select("part", "path", "n_tokens").collect())
    bases, total = [], 0
    for part, path, n_tokens in parts:
        bases.append((path, total))
        total += n_tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if not bases:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, _ = open_folder(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                reader = SequenceReader(source, f"{path}.ids.arrow")
                with source.open_input_file(f"{path}.docs.arrow") as listed:
                    index = pa.ipc.open_file(listed)
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        crcs = []
                        for start, count in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()):
                            crc = 0
                            for view in reader.run(start, count):
                                crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                            crcs.append(crc)
                        starts = pa.compute.add(docs.column("start"), base)
                        yield pa.RecordBatch.from_arrays([docs.column("doc_id"), starts, docs.column("n_tokens"), pa.array(crcs, pa.int64())], names=names)

    listed = spark.createDataFrame(bases, "path string, base long").repartition(len(bases))
    return listed.mapInArrow(run, schema)


def read_sequences(manifest: DataFrame, folder: str, rows: list[int], length: int = LENGTH) -> list[tuple[list[int], list[bool]]]:
    """Ids and masks of single rows, counted over all files in order; each file's last row may be masked in part."""
    parts = sorted(manifest.select("part", "path", "n_tokens").collect())
    firsts, total = [], 0
    for _, _, n_tokens in parts:
        firsts.append(total)
        total += -(-n_tokens // length)
    source, _ = open_folder(folder)
    out = []
    for row in rows:
        file = bisect_right(firsts, row) - 1
        ids, mask = SequenceReader(source, f"{parts[file][1]}.ids.arrow").sequence(row - firsts[file])
        out.append((ids.tolist(), mask.tolist()))
    return out
