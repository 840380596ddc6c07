"""What five filters remove in every order, and what they cost each other.

Every document becomes a mask of the filters it fails.  Four filters read the document alone; the
fifth (a copy of an earlier text) needs the whole table.  For it, tasks count hashes of texts in
small sketches, the sketches are merged cell by cell, and a text that has a cell for itself is
unique for certain.  Only the other texts are shuffled and grouped, whole, for the least id of each.

The merged sketch keeps one bit for each cell (met twice or more) and is read by the tasks from the
shared folder.  Its size is bounded by ``SKETCH_BYTES``; a table too large for it gets fewer cells
for each text, so that fewer texts are cleared, and the result stays the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.llm.tables import open_folder, raw_texts, slices, written
from keysift.session import broadcast_if_small, scratch_path

LETTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITALS_PERCENT = 5
CAPITALS, SYMBOLS = bytes(range(0x41, 0x5B)), b"#$%&*|"
#: The bit of the filter that asks for earlier copies.
COPY = 1 << LETTERS.index("E")

# The whole sketch, in bytes of its bits; a part that one task merges; cells for each text, and how many of them a text sets.
SKETCH_BYTES = 128 * 1024 * 1024
PART_CELLS = 1 << 21
CELLS_PER_TEXT = 10
HASHES = 4
# Texts whose cells are counted in one local sketch.
LOCAL_TEXTS = 1 << 18

MARKED = "doc_id long, part string, mask int, high long, low long"
PIECES = "part long, cells binary, counts binary"
CROWDED = "part long, bits binary"


def digest(raw: bytes) -> tuple[int, int]:
    """128 bits of a text as two signed integers."""
    value = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(value[:8], "little", signed=True), int.from_bytes(value[8:], "little", signed=True)


def own_mask(raw: bytes, code_points: int) -> int:
    """The filters A to D that a text fails, as bits."""
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MAX_CAPITALS_PERCENT * code_points) << 2
        | (len(raw) != len(raw.translate(None, SYMBOLS))) << 3
    )


def marked(docs: DataFrame) -> DataFrame:
    """Part, own mask and digest of every document, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            texts = raw_texts(piece)
            points = pc.utf8_length(piece.column("text")).to_pylist()
            halves = [digest(t) for t in texts]
            columns = [
                piece.column("doc_id"), piece.column("part"), pa.array(map(own_mask, texts, points), pa.int32()),
                pa.array([h for h, _ in halves], pa.int64()), pa.array([w for _, w in halves], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "mask", "high", "low"])

    return written(docs.mapInArrow(run, MARKED), "audit-marks")


class Shape:
    """Number of cells and of hashes of a sketch for ``texts`` texts."""

    def __init__(self, texts: int, limit: int = SKETCH_BYTES):
        self.cells = int(min(max(64, texts * CELLS_PER_TEXT), limit * 8))
        # As many hashes as the cells for each text allow before most cells are crowded.
        self.hashes = max(1, min(HASHES, round(0.7 * self.cells / max(1, texts))))

    def of(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The cells of digests, one row of ``hashes`` for each."""
        step = low.astype(np.uint64) | np.uint64(1)
        start = high.astype(np.uint64)
        with np.errstate(over="ignore"):
            walked = start[:, None] + np.arange(self.hashes, dtype=np.uint64)[None, :] * step[:, None]
        return ((walked >> np.uint64(11)) % np.uint64(self.cells)).astype(np.int64)


def _long(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def merged_sketch(digests: DataFrame, shape: Shape) -> str:
    """Count the cells of all digests in local sketches and merge them; returns the folder of the crowded cells.

    A count stops at two, which is all that is asked of it, so a text that a third of all rows share
    sends its few cells once from each local sketch.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sketch(held: list[np.ndarray]) -> pa.RecordBatch:
            # A text counts once in each of its cells, also where two of its hashes meet.
            rows = np.sort(np.concatenate(held), axis=1)
            first = np.ones(rows.shape, bool)
            first[:, 1:] = rows[:, 1:] != rows[:, :-1]
            cells, counts = np.unique(rows[first], return_counts=True)
            counts = np.minimum(counts, 2).astype(np.uint8)
            cuts = np.flatnonzero(np.diff(cells // PART_CELLS)) + 1
            parts = [(p, c) for p, c in zip(np.split(cells, cuts), np.split(counts, cuts)) if len(p)]
            columns = [
                pa.array([int(p[0] // PART_CELLS) for p, _ in parts], pa.int64()),
                pa.array([(p % PART_CELLS).astype("<u4").tobytes() for p, _ in parts], pa.binary()),
                pa.array([c.tobytes() for _, c in parts], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["part", "cells", "counts"])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(shape.of(_long(batch, "high"), _long(batch, "low")))
                n += batch.num_rows
            if n >= LOCAL_TEXTS:
                yield sketch(held)
                held, n = [], 0
        if n:
            yield sketch(held)

    def merge(pieces: pa.Table) -> pa.Table:
        counts = np.zeros(PART_CELLS, np.uint8)
        for cells, more in zip(pieces.column("cells").to_pylist(), pieces.column("counts").to_pylist()):
            at = np.frombuffer(cells, "<u4")
            counts[at] = np.minimum(counts[at] + np.frombuffer(more, np.uint8), 2)
        bits = np.packbits(counts == 2).tobytes()
        return pa.table([pieces.column("part").slice(0, 1), pa.array([bits], pa.binary())], names=["part", "bits"])

    folder = scratch_path(digests.sparkSession, "audit-sketch")
    digests.select("high", "low").mapInArrow(local, PIECES).groupBy("part").applyInArrow(merge, CROWDED).write.parquet(folder)
    return folder


# The last sketch that a worker read, by its folder.
_read: dict[str, np.ndarray] = {}


def crowded_cells(folder: str, shape: Shape) -> np.ndarray:
    """The bits of all cells, read from the shared folder once for each worker."""
    if folder not in _read:
        _read.clear()
        source, root = open_folder(folder)
        parts = pyarrow.dataset.dataset(root, filesystem=source, format="parquet")
        bits = np.zeros(-(-shape.cells // PART_CELLS) * (PART_CELLS // 8), np.uint8)
        for batch in parts.to_batches():
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist()):
                bits[part * (PART_CELLS // 8) : (part + 1) * (PART_CELLS // 8)] = np.frombuffer(packed, np.uint8)
        _read[folder] = bits
    return _read[folder]


def possible_repeats(folder: str, shape: Shape, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether all cells of a digest were met twice; false means that no other row has the text."""
    bits, cells = crowded_cells(folder, shape), shape.of(high, low)
    return ((bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=1)


def with_repeats(marks: DataFrame, folder: str, shape: Shape) -> DataFrame:
    """Marks with ``maybe``: the sketch does not rule out another row with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                maybe = possible_repeats(folder, shape, _long(batch, "high"), _long(batch, "low"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], names=[*batch.schema.names, "maybe"])

    return marks.mapInArrow(run, f"{MARKED}, maybe boolean")


def first_copies(docs: DataFrame, folder: str, shape: Shape) -> DataFrame:
    """``doc_id``, ``high`` and ``low`` of the least id of every text that the sketch does not clear."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            halves = [digest(t) for t in raw_texts(piece)]
            high = np.array([h for h, _ in halves], np.int64)
            low = np.array([w for _, w in halves], np.int64)
            chosen = pa.array(possible_repeats(folder, shape, high, low))
            if chosen.true_count:
                columns = [piece.column("doc_id"), pa.array(high), pa.array(low), piece.column("text")]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "high", "low", "text"]).filter(chosen)

    asked = docs.where("doc_id is not null").select("doc_id", "text")
    candidates = asked.mapInArrow(run, "doc_id long, high long, low long, text string")
    # Grouped by the whole text; copies meet inside their task first.
    return candidates.groupBy("high", "low", "text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "high", "low")


def masks(docs: DataFrame, part: str, limit: int = SKETCH_BYTES) -> DataFrame:
    """``doc_id``, ``part`` and the full mask of every document, bit i for filter i of ``LETTERS``.

    Null texts count as empty, a null part as the empty string.  Rows that share id and text are no
    copies of each other; a row without an id is no copy and makes none.
    """
    columns = {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string"), "part": F.col(part).cast("string")}
    own = docs.select(columns["doc_id"].alias("doc_id"), *(F.coalesce(columns[c], F.lit("")).alias(c) for c in ("text", "part")))
    marks = marked(own.select("doc_id", "part", "text"))
    texts = marks.count()
    if not texts:
        return marks.select("doc_id", "part", "mask")
    shape = Shape(texts, limit)
    folder = merged_sketch(marks, shape)
    marks = with_repeats(marks, folder, shape)
    asked = F.col("maybe") & F.col("doc_id").isNotNull()
    # A repeated text's rows are copies, but for the row that has its least id.
    firsts = first_copies(own, folder, shape).withColumn("first", F.lit(True))
    settled = marks.where(asked).join(firsts, ["doc_id", "high", "low"], "left")
    later = settled.withColumn("mask", F.when(F.col("first").isNull(), F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")))
    return marks.where(~asked).select("doc_id", "part", "mask").union(later.select("doc_id", "part", "mask"))


def orders() -> list[tuple[str, int, int, int]]:
    """Every order of the filters: name, step from 1, the step's bit, the bits of the steps before."""
    out = []
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def _sum(condition: Column, value: str | Column) -> Column:
    amount = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0)).cast("long")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", limit: int = SKETCH_BYTES) -> DataFrame:
    """One row for each part, order of the filters and step, with counts of documents.

    ``kept`` (after the step), ``removed`` (by it), ``redundant`` (failing it, removed before),
    ``unique_fails`` (failing it only), ``good_lost`` and ``toxic_lost`` (removed by it, labelled
    quality=1 or toxic=1), ``shapley`` (its filter's removals, summed over all orders).

    Rules for null and repeated rows are those of ``masks``.  An id labelled more than once is good
    or toxic if any of its labels says so; labels without an id or a value say nothing.  An empty
    table gives no rows.  Other columns are not read.
    """
    said = labels.select(F.col("doc_id").cast("long").alias("labelled"), "quality", "toxic").where("labelled is not null")
    said = said.groupBy("labelled").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    counted = written(masks(docs, part, limit), "audit-masks")
    flags = counted.where("doc_id is not null").join(broadcast_if_small(said), F.col("doc_id") == F.col("labelled"), "left")
    unnamed = counted.where("doc_id is null").select("part", "mask", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("bad"))
    # All that follows works on these sums: at most 32 rows for each part.
    sums = flags.select("part", "mask", "good", "bad").union(unnamed).groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("bad").alias("n_bad"),
    )
    # A filter's removals depend on the set of those before it, not on their order.
    steps = orders()
    states = sorted({(bit, before) for _, _, bit, before in steps})
    listed = F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in states))
    spread = sums.withColumn("state", F.explode(listed)).select("*", "state.*")
    fails, reached = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    # Of all orders, one in so many as a document's failed filters has this filter first among them.
    share = F.col("n") * len(set(s[0] for s in steps)) / F.bit_count("mask")
    states_counted = spread.groupBy("part", "bit", "before").agg(
        _sum(~fails & reached, "n").alias("kept"), _sum(fails & reached, "n").alias("removed"), _sum(fails & ~reached, "n").alias("redundant"),
        _sum(F.col("mask") == F.col("bit"), "n").alias("unique_fails"), _sum(fails & reached, "n_good").alias("good_lost"),
        _sum(fails & reached, "n_bad").alias("toxic_lost"), _sum(fails, share).alias("shapley"),
    )
    # 600 rows, whatever the data.
    named = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, bit int, before int")
    results = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return states_counted.join(F.broadcast(named), ["bit", "before"]).select("part", "filter_order", "step", *results)


def passing(docs: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id`` of the documents that no filter removes."""
    return masks(docs, part).where("mask = 0").select("doc_id")


def failed(mask: Column) -> Column:
    """The letters of a mask's filters, in order."""
    return reduce(F.concat, [F.when(mask.bitwiseAND(1 << i) != 0, letter).otherwise("") for i, letter in enumerate(LETTERS)])
