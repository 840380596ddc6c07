"""Benchmark decontamination by suffix arrays over shards of the training documents.

A shard is a slice of a partition's documents.  Its suffix array holds the positions at which a match
can start at all: those followed by at least as many words of the benchmark's vocabulary as the
shortest window has.  Every suffix of every item is searched in it; the range of suffixes that begin
with the item's window gives the locations, which are then extended to the longest verbatim match.
Documents never cross shards, so nothing is shuffled.  Items go out in blocks of bounded size, one
pass each over the same stream of documents.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysift.llm.tables import raw_texts, slices, text_only
from keysift.llm.words import alnum_words, spans_of, suffix_array

# Text bytes of the items broadcast together.
BLOCK_BYTES = 8 * 1024 * 1024
# Text bytes of the documents of one shard.
SHARD_BYTES = 8 * 1024 * 1024

MARKED = "n_words long, n_hit long, marks binary, longest long, items array<string>"


def item_blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items as (id, text) in lists of at most ``limit`` text bytes, or one item."""
    block, held = [], 0
    for item, text in items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        raw = (text or "").encode()
        if block and held + len(raw) > limit:
            yield block
            block, held = [], 0
        block.append((item, raw))
        held += len(raw)
    yield block


class Searcher:
    """Suffixes of a block of items, searched in shards of documents."""

    def __init__(self, block: list[tuple[str | None, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.items: list[tuple[str | None, list[int], int]] = []
        for item, raw in block:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in alnum_words(raw)]
            if words:
                self.items.append((item, words, min(window, len(words))))
        self.least = min((size for _, _, size in self.items), default=0)
        self.depth = max((len(words) for _, words, _ in self.items), default=0)

    def number(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words; 0 for those that no item holds."""
        return np.fromiter((self.numbers.get(w, 0) for w in words), np.int64, len(words))

    def search(self, shard: np.ndarray) -> Iterator[tuple[str | None, int, np.ndarray, np.ndarray]]:
        """Item, window size, places in the shard and lengths of verbatim matches, for each suffix found.

        ``shard`` holds documents end to end, a 0 after each.
        """
        inside = shard > 0
        stops = np.flatnonzero(~inside)
        run = stops[np.searchsorted(stops, np.arange(len(shard)))] - np.arange(len(shard)) if len(stops) else np.zeros(0, np.int64)
        first = inside & (np.concatenate([[True], ~inside[:-1]]) if len(shard) else inside)
        long = first & (run >= self.least)
        keep = np.zeros(len(shard) + 1, np.int64)
        np.add.at(keep, np.flatnonzero(long), 1)
        np.add.at(keep, np.flatnonzero(long) + run[long] + 1, -1)
        kept = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
        if not len(kept):
            return
        values = shard[kept]
        order, _ = suffix_array(values, self.depth)
        order = order[run[kept][order] >= self.least]
        packed = values.astype(">u4").tobytes()
        present = set(values.tolist())
        places = range(len(order))
        at = order.tolist()
        for item, words, size in self.items:
            for j in range(len(words) - size + 1):
                if words[j] not in present or words[j + size - 1] not in present:
                    continue
                wanted = np.array(words[j : j + size], ">u4").tobytes()

                def head(r: int, width: int = 4 * size) -> bytes:
                    return packed[4 * at[r] : 4 * at[r] + width]

                low = bisect_left(places, wanted, key=head)
                high = bisect_right(places, wanted, low, key=head)
                if low < high:
                    found = order[low:high]
                    length, alive = np.full(high - low, size), np.ones(high - low, bool)
                    for step in range(size, len(words) - j):
                        alive &= values[np.minimum(found + step, len(values) - 1)] == words[j + step]
                        if not alive.any():
                            break
                        length[alive] += 1
                    yield item, size, kept[found], length


def _search_pass(docs: DataFrame, block: list[tuple[str | None, bytes]], window: int, first: bool) -> DataFrame:
    """Search one block of items and add what it finds to the columns ``marks``, ``longest`` and ``items``."""
    shipped = docs.sparkSession.sparkContext.broadcast(block)
    carried = [f for f in docs.schema.fields if first or f.name not in ("n_words", "n_hit", "marks", "longest", "items")]
    schema = T.StructType([*carried, *T._parse_datatype_string(MARKED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shipped.value, window)
        for part in slices(batches, SHARD_BYTES):
            numbers = [searcher.number(alnum_words(raw)) for raw in raw_texts(part)]
            sizes = np.array([len(x) for x in numbers], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes + 1)])
            shard = np.zeros(starts[-1], np.int64)
            for x, start in zip(numbers, starts.tolist()):
                shard[start : start + len(x)] = x
            del numbers
            covered = np.zeros(len(shard) + 1, np.int64)
            longest = np.zeros(part.num_rows, np.int64)
            items: dict[int, set[str]] = {}
            for item, size, found, length in searcher.search(shard):
                np.add.at(covered, found, 1)
                np.add.at(covered, found + size, -1)
                rows = np.searchsorted(starts, found, side="right") - 1
                np.maximum.at(longest, rows, length)
                if item is not None:
                    for row in np.unique(rows).tolist():
                        items.setdefault(row, set()).add(item)
            hit = np.cumsum(covered[:-1]) > 0
            if first:
                old_marks, old_longest, old_items = [b""] * part.num_rows, [0] * part.num_rows, [[]] * part.num_rows
            else:
                old_marks, old_longest, old_items = (part.column(c).to_pylist() for c in ("marks", "longest", "items"))
            marks, hits = [], []
            for row, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist())):
                own, old = hit[start : start + size], old_marks[row]
                if old:
                    own = own | np.unpackbits(np.frombuffer(old, np.uint8), count=size).astype(bool)
                hits.append(int(own.sum()))
                marks.append(np.packbits(own).tobytes() if hits[-1] else b"")
            columns = [
                *(part.column(f.name) for f in carried), pa.array(sizes), pa.array(hits, pa.int64()), pa.array(marks, pa.binary()),
                pa.array([max(a, b) for a, b in zip(longest.tolist(), old_longest)], pa.int64()),
                pa.array([sorted(items.get(row, set()).union(old)) for row, old in enumerate(old_items)], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def _searched(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    for number, block in enumerate(item_blocks(items)):
        docs = _search_pass(docs, block, window, number == 0)
    return docs.drop("text").withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def matches(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """Verbatim matches of benchmark items in each document.

    Words are lower-cased runs of ASCII letters, digits and characters beyond ASCII.  A window is
    ``window`` consecutive words of an item, or a shorter item as a whole.  One row per document:
    ``doc_id``, ``n_words``, ``spans`` (start and end word of the runs covered by windows), ``n_hit``
    (words covered), ``longest`` (words of the longest verbatim match), ``items`` (their sorted ids),
    ``contaminated`` (a hit, and at least a twentieth of the words covered), ``items_sha256``.

    Null and empty texts have no words and are clean; items without words match nothing; an item
    without id covers words but is not listed; items that share an id are listed once.  Repeated
    documents give repeated rows; other columns are not read.
    """
    found = _searched(text_only(docs), items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, digests = [], []
            for size, marks, ids in zip(*(batch.column(c).to_pylist() for c in ("n_words", "marks", "items"))):
                own = spans_of(np.unpackbits(np.frombuffer(marks, np.uint8), count=size).astype(bool)) if marks else []
                spans.append([{"start": a, "end": b} for a, b in own])
                digests.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kept = [batch.column(c) for c in ("doc_id", "n_words", "n_hit", "longest", "items", "contaminated")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, kind), pa.array(digests, pa.string())], names=names)

    schema = (
        "doc_id long, n_words long, n_hit long, longest long, items array<string>, contaminated boolean, "
        "spans array<struct<start: long, end: long>>, items_sha256 string"
    )
    names = ["doc_id", "n_words", "n_hit", "longest", "items", "contaminated", "spans", "items_sha256"]
    return found.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """The documents that are not contaminated, with all their columns; rules as in ``matches``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    found = _searched(docs.select(F.struct("*").alias("row"), text), items, window)
    return found.where(~F.col("contaminated")).select("row.*")
