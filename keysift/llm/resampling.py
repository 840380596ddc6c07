"""Importance resampling towards a target: hashed n-gram weights, and exact ranks by regular sampling.

Weights come from an array of gains, one for each bucket of hashed n-grams.  Scores are ranked
without a global sort of rows: each task sorts its rows in bounded runs, evenly spaced members of
the runs give splitters, every run is cut at the splitters, the pieces of a segment are merged, and
the counts of the segments before it give the ranks.  Only segments that the draw reaches are moved.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.tables import raw_texts, slices, text_only, written
from keysift.llm.words import alnum_words

BUCKETS = 10_000
SEED = 2024
SCALE = 1000
# Words whose bucket a worker remembers.
KNOWN_WORDS = 500_000
# Rows of a sorted run, and members of runs that choose the splitters (on the driver).
RUN_ROWS = 1 << 17
SAMPLES = 1 << 18
# Members that every run gives for each segment, while those of all runs stay within ``SAMPLES``.
PER_SEGMENT = 4
# Segments grow with the root of the rows, as their size does, so that runs are not cut into ever smaller pieces.
ROWS_PER_SQUARE = 256

RUNS = "run long, eligible boolean, ids array<long>, named array<boolean>, features array<long>, weights array<long>, scores array<long>"
PIECES = "segment int, " + RUNS.replace("eligible boolean, ", "")
ROWS = "doc_id long, n_features long, weight long, score long, rank long"
LAST = np.iinfo(np.int64).max


class Buckets(dict):
    """Buckets of n-grams, those of the last words remembered."""

    def __missing__(self, gram: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[gram] = bucket = zlib.crc32(gram) % BUCKETS
        return bucket

    def of(self, raw: bytes, longest: int) -> np.ndarray:
        """The buckets of all runs of 1 to ``longest`` consecutive words."""
        words = alnum_words(raw)
        grams = list(words)
        for n in range(2, longest + 1):
            grams += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        return np.fromiter(map(self.__getitem__, grams), np.int64, len(grams))


def bucket_counts(texts: DataFrame, longest: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; every task sends at most one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, counts = Buckets(), np.zeros(BUCKETS, np.int64)
        for piece in slices(batches):
            for raw in raw_texts(piece):
                counts += np.bincount(buckets.of(raw, longest), minlength=BUCKETS)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled logarithms of how much likelier a bucket is in the target, smoothed by one in every bucket."""
    s, t = source.tolist(), target.tolist()
    all_s, all_t = float(sum(s) + len(s)), float(sum(t) + len(t))
    return np.array([math.floor(SCALE * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s, t)], np.int64)


def draw_of(doc_id: int | None, seed: int) -> int:
    """The document's own Gumbel draw, scaled; a null id is written as nothing."""
    name = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    h = int(hashlib.sha256(name).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def _packed(columns: list[list], kinds: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(columns, kinds)]


LISTS = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
NAMES = ["ids", "named", "features", "weights", "scores"]


def sorted_runs(docs: DataFrame, table: np.ndarray, longest: int, min_words: int, seed: int, run_rows: int) -> DataFrame:
    """Scored documents in packed runs of at most ``run_rows``, each in the order of rank; written once.

    Documents with fewer than ``min_words`` words travel in runs of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        buckets, gain = Buckets(), shared.value
        held = {True: [], False: []}

        def packed(eligible: bool) -> pa.RecordBatch:
            nonlocal number
            rows = np.array(held[eligible], np.int64).reshape(-1, 5)
            held[eligible] = []
            rows = rows[np.lexsort((rows[:, 0], -rows[:, 4]))]
            columns = [[rows[:, 0]], [rows[:, 1].astype(bool)], [rows[:, 2]], [rows[:, 3]], [rows[:, 4]]]
            number += 1
            head = [pa.array([number], pa.int64()), pa.array([eligible])]
            return pa.RecordBatch.from_arrays([*head, *_packed(columns, LISTS)], names=["run", "eligible", *NAMES])

        for piece in slices(batches):
            for doc_id, raw in zip(piece.column("doc_id").to_pylist(), raw_texts(piece)):
                hit = buckets.of(raw, longest)
                n_words = len(hit) if longest == 1 else len(alnum_words(raw))
                weight = int(gain[hit].sum()) // len(hit) if len(hit) else 0
                row = (LAST if doc_id is None else doc_id, doc_id is not None, len(hit), weight, weight + draw_of(doc_id, seed))
                held[n_words >= min_words].append(row)
            for eligible, rows in held.items():
                if len(rows) >= run_rows:
                    yield packed(eligible)
        for eligible, rows in held.items():
            if rows:
                yield packed(eligible)

    return written(docs.mapInArrow(run, RUNS), "resampling-runs")


def splitters_of(runs: DataFrame, each: int, segments: int) -> list[tuple[int, int, int, int]]:
    """Splitters of ``segments`` segments, as (-score, id, run, place): evenly spaced among up to ``each`` evenly spaced members of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, scores = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "scores"))
                at = np.unique(np.arange(each) * len(ids) // each)
                numbers = np.full(len(at), batch.column("run")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (-scores[at], ids[at], numbers, at)], names=["s", "id", "run", "place"])

    members = runs.select("run", "ids", "scores").mapInArrow(run, "s long, id long, run long, place long").toArrow()
    members = members.sort_by([(c, "ascending") for c in members.column_names])
    chosen = sorted({len(members) * i // segments for i in range(1, segments)})
    return [tuple(r.values()) for r in members.take(chosen).to_pylist()]


def cuts(scores: np.ndarray, ids: np.ndarray, number: int, splitters: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Where a run is cut by each splitter; rows alike in score and id are told apart by run and place."""
    keys = -scores
    low = np.searchsorted(keys, [s for s, _, _, _ in splitters], "left")
    high = np.searchsorted(keys, [s for s, _, _, _ in splitters], "right")
    out = np.empty(len(splitters) + 2, np.int64)
    out[0], out[-1] = 0, len(ids)
    for i, (_, doc_id, run, place) in enumerate(splitters):
        side = "right" if number < run else "left"
        out[i + 1] = place if number == run else low[i] + np.searchsorted(ids[low[i] : high[i]], doc_id, side)
    return out


def ranked(runs: DataFrame, drawn: int, sizes: list[int], segments: int | None = None, samples: int = SAMPLES) -> DataFrame:
    """Rows of all runs with the rank of the first ``drawn`` of the eligible ones, by score downwards, then id.

    ``sizes`` are the lengths of the eligible runs, one number for each run.
    """
    spark = runs.sparkSession
    eligible = runs.where("eligible").drop("eligible")
    segments = segments or math.isqrt(sum(sizes) // ROWS_PER_SQUARE) + 1
    each = max(1, min(PER_SEGMENT * segments, samples // max(1, len(sizes))))
    splitters = splitters_of(eligible, each, segments) if sizes and segments > 1 else []
    shared = spark.sparkContext.broadcast(splitters)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, scores = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "scores"))
                counts += np.diff(cuts(scores, ids, batch.column("run")[i].as_py(), shared.value))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts)], names=["segment", "n"])

    # One number for each segment.
    held = dict(eligible.select("run", "ids", "scores").mapInArrow(counted, "segment int, n long").groupBy("segment").agg(F.sum("n")).collect())
    before = np.concatenate([[0], np.cumsum([held.get(i, 0) for i in range(len(splitters) + 1)])]).tolist()
    # Segments from this one on have no drawn row.
    reached = next((i for i in range(len(splitters) + 1) if before[i] >= drawn), len(splitters) + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lists = [batch.column(c)[i].values for c in NAMES]
                ids, scores = (lists[NAMES.index(c)].to_numpy(zero_copy_only=False) for c in ("ids", "scores"))
                number = batch.column("run")[i].as_py()
                edges = cuts(scores, ids, number, shared.value).tolist()
                # What the draw does not reach stays one piece, in no segment.
                pieces = [(s, edges[s], edges[s + 1]) for s in range(reached)] + [(-1, edges[reached], edges[-1])]
                for segment, start, stop in pieces:
                    if start < stop:
                        columns = [pa.array([segment], pa.int32()), pa.array([number], pa.int64())]
                        columns += [pa.ListArray.from_arrays(pa.array([0, stop - start], pa.int32()), values.slice(start, stop - start)) for values in lists]
                        yield pa.RecordBatch.from_arrays(columns, names=["segment", "run", *NAMES])

    def merge(pieces: pa.Table) -> pa.Table:
        segment = pieces.column("segment")[0].as_py()
        pieces = pieces.sort_by("run")
        joined = [pa.concat_arrays([v.values for v in pieces.column(c)]) for c in NAMES]
        ids, scores = (joined[NAMES.index(c)].to_numpy(zero_copy_only=False) for c in ("ids", "scores"))
        order = np.lexsort((ids, -scores))
        ranks = np.arange(before[segment] + 1, before[segment] + 1 + len(order))
        ids, named, features, weights, scores = (c.take(pa.array(order)) for c in joined)
        rank = pa.array(ranks, mask=ranks > drawn)
        return pa.table([pc.if_else(named, ids, pa.scalar(None, pa.int64())), features, weights, scores, rank], names=["doc_id", "n_features", "weight", "score", "rank"])

    pieces = eligible.mapInArrow(cut, PIECES)
    first = pieces.where("segment >= 0").groupBy("segment").applyInArrow(merge, ROWS)
    rest = pieces.where("segment < 0").select(*NAMES).union(runs.where("not eligible").select(*NAMES))
    opened = rest.select(F.explode(F.arrays_zip(*NAMES)).alias("r")).select(
        F.when(F.col("r.named"), F.col("r.ids")).alias("doc_id"), F.col("r.features").alias("n_features"), F.col("r.weights").alias("weight"),
        F.col("r.scores").alias("score"), F.lit(None).cast("long").alias("rank"),
    )
    return first.union(opened)


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest: int = 1, seed: int = SEED,
    run_rows: int = RUN_ROWS, segments: int | None = None, samples: int = SAMPLES,
) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn) of every document.

    The ``percent`` of the documents with ``min_words`` words or more that score highest are drawn:
    without replacement, in proportion to the weights.  Features are runs of 1 to ``longest`` words.

    Null and empty texts have no features and weight 0.  Ties go to the smaller id; rows alike in
    score and id are ranked one after the other, and a null id comes last.  Every row is a document
    of its own, repeated rows too.  Without target texts all gains come from the documents alone.
    An empty table gives no rows.  Other columns are not read.
    """
    docs = text_only(docs)
    texts = target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = gains(bucket_counts(docs.select("text"), longest), bucket_counts(texts, longest))
    runs = sorted_runs(docs, table, longest, min_words, seed, run_rows)
    sizes = [n for (n,) in runs.where("eligible").select(F.size("ids")).collect()]
    return ranked(runs, percent * sum(sizes) // 100, sizes, segments, samples)


def drawn(docs: DataFrame, target: DataFrame, percent: int = 10, **rest) -> DataFrame:
    """``doc_id`` and ``rank`` of the drawn documents."""
    return resampled(docs, target, percent, **rest).where("rank is not null").select("doc_id", "rank")
