"""Language-model scores from an Elias-Fano n-gram trie.

The model interpolates bigrams with unigrams: after a context h met c(h) times in training, a word has
probability (c(h w) + PRIOR * P(w)) / (c(h) + PRIOR), with P(w) = (c(w) + 1) / (N + V + 1), which adds up
to one over the vocabulary and one unknown word.  The trie holds the quantised logarithms of
c(h w) / (c(h) + PRIOR); the rest follows from the counts of words.

Blocks of documents send their distinct words to shards, which count them and number those met in
training; then their distinct pairs of numbers, dealt out by context, hot contexts by the pair.  A
pair shard adds up the counts, writes its part of the trie to the shared folder, maps it into
memory, and answers the blocks' pairs by successor search within the context.  So model and
queries meet shard by shard, and no task or driver holds the model.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.llm.elias_fano import BigramTrie
from keysift.llm.exchange import by_range, by_shard, gathered, packed, shard_count, unpacked
from keysift.llm.tables import open_folder, raw_texts, slices
from keysift.llm.words import Numbering, lower_words
from keysift.session import scratch_path

BLOCK_BYTES = 10 * 1024 * 1024
# Occurrences by which a context's own counts outweigh the unigrams.
PRIOR = 20.0
# Logarithms are kept in steps of a fortieth; code 0 is a pair not met.  A context so frequent that a pair met once
# is more than LEVELS of these below it has wider steps, of which that pair is just LEVELS away.
STEP = 0.025
LEVELS = 254
# Occurrences from which a context's pairs are dealt out one by one.
HOT = 50_000
END = b""

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents as numbers of their own words, frequent ones first; the end of a text is a word too.

    ``words`` are the words' hashes in ascending order, ``ranks`` the words' numbers in that order.
    """
    schema = (
        "block long, doc_ids array<long>, train binary, sizes binary, tokens binary, ranks binary, words binary, counts binary, "
        "n_words long, n_tokens long"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, piece in enumerate(slices(batches, BLOCK_BYTES)):
            numbering = Numbering()
            end = numbering[END]
            texts = [np.append(numbering.of(lower_words(raw)), end) for raw in raw_texts(piece)]
            sizes = np.array([len(t) for t in texts], np.int64)
            tokens = np.concatenate(texts)
            train = np.array(piece.column("train").to_pylist(), bool)
            order = np.argsort(-np.bincount(tokens, minlength=len(numbering)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            tokens = rank[tokens]
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbering), np.uint64, len(numbering))
            by_hash = np.argsort(hashes)
            ranks = rank[by_hash]
            counts = np.bincount(tokens[np.repeat(train, sizes)], minlength=len(order))[ranks]
            binaries = [train.tobytes(), packed(sizes), packed(tokens), packed(ranks), hashes[by_hash].tobytes(), packed(counts)]
            row = [(part << 32) + number, piece.column("doc_id").to_pylist(), *binaries, len(hashes), len(tokens)]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    return _kept(docs.mapInArrow(run, schema), "lm-blocks")


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _split(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def _vocabulary(blocks: DataFrame, shards: int) -> DataFrame:
    """Number (0: not in training) and count of each block's words, by (``block``, ``shard``); a shard's first row has its totals."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = np.frombuffer(row["words"], np.uint64), unpacked(row["counts"])
                parts = list(by_range(words, shards))
                columns = [[s for s, _ in parts], [row["block"]] * len(parts), [words[at].tobytes() for _, at in parts], [packed(counts[at]) for _, at in parts]]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "block", "words", "counts"])

    def meet(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        counts = np.concatenate([unpacked(x) for x in table.column("counts").to_pylist()])
        words, place = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.zeros(len(words), np.uint64)
        np.add.at(total, place, counts)
        number = np.cumsum(total > 0) - 1
        number = np.where(total > 0, number * shards + table.column("shard")[0].as_py() + 1, 0)
        sizes = [len(x) for x in lists]
        replies = [[packed(x) for x in _split(values[place], sizes)] for values in (number, total)]
        rest = [0] * (len(sizes) - 1)
        totals = [[int((total > 0).sum()), *rest], [int(total.sum()), *rest], [int(number.max()), *rest]]
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip([*replies, *totals], kinds)]
        return pa.table([table.column("block"), table.column("shard"), *columns], names=names)

    schema = "block long, shard long, numbers binary, counts binary, types long, tokens long, top long"
    names = [c.split()[0] for c in schema.split(", ")]
    sent = blocks.select("block", "words", "counts").mapInArrow(send, "shard long, block long, words binary, counts binary")
    return _kept(sent.groupBy("shard").applyInArrow(meet, schema), "lm-vocabulary")


def _looked_up(row: dict, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Number and training count of each of a block's words."""
    parts = sorted(zip(*(replies.column(c).to_pylist() for c in ("shard", "numbers", "counts"))))
    ranks = unpacked(row["ranks"]).astype(np.int64)
    out = []
    for values in ([n for _, n, _ in parts], [c for _, _, c in parts]):
        own = np.empty(len(ranks), np.uint64)
        own[ranks] = np.concatenate([unpacked(v) for v in values])
        out.append(own)
    return out[0], out[1]


def _pairs(row: dict, numbers: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a block, the places of tokens whose pair with the one before may be in the model, and those pairs."""
    tokens, sizes = unpacked(row["tokens"]).astype(np.int64), unpacked(row["sizes"]).astype(np.int64)
    own = numbers[tokens]
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(sizes) - sizes] = False
    places = np.flatnonzero(inner & (own > 0))
    places = places[own[places - 1] > 0]
    return tokens, places, own[places - 1] * np.uint64(span) + own[places]


def _pair_shard(keys: np.ndarray, span: int, hot: np.ndarray) -> np.ndarray:
    """What a pair is dealt out by: its context, or the pair where the context is hot."""
    mixed = np.where(hot, keys, keys // np.uint64(span)) * _M1
    return (mixed ^ (mixed >> np.uint64(32))) * _M2 >> np.uint64(16)


def _distinct(places: np.ndarray, keys: np.ndarray, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a block and how often each stands in its training documents."""
    sizes = unpacked(row["sizes"]).astype(np.int64)
    train = np.repeat(np.frombuffer(row["train"], bool), sizes)[places]
    both = np.sort((keys << np.uint64(1)) | train.astype(np.uint64))
    pairs = both >> np.uint64(1)
    starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    counts = np.add.reduceat(both & np.uint64(1), starts) if len(starts) else both
    return pairs[starts], counts


def _cells(row: dict, replies: pa.Table, pair_shards: int, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Shard, ascending pairs, their counts, and the counts of the pairs' contexts."""
    numbers, counts = _looked_up(row, replies)
    _, places, keys = _pairs(row, numbers, span)
    pairs, times = _distinct(places, keys, row)
    heads = np.flatnonzero(np.concatenate([[True], np.diff(pairs // np.uint64(span)) != 0])) if len(pairs) else np.zeros(0, np.int64)
    order = np.argsort(numbers)
    contexts = counts[order[np.searchsorted(numbers[order], pairs[heads] // np.uint64(span))]] if len(heads) else np.zeros(0, np.uint64)
    context = np.repeat(contexts, np.diff(np.append(heads, len(pairs))))
    for shard, at in by_shard(_pair_shard(pairs, span, context >= HOT), pair_shards):
        yield shard, pairs[at], times[at], context[at]


def _heads(pairs: np.ndarray, span: int) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], np.diff(pairs // np.uint64(span)) != 0]))


def _steps(context: np.ndarray, prior: float) -> np.ndarray:
    return np.maximum(STEP, np.log10(context + prior) / LEVELS)


def _codes(count: np.ndarray, context: np.ndarray, prior: float) -> np.ndarray:
    """Codes of pairs met ``count`` times, by the occurrences of their contexts."""
    logs = np.log10(count / (context + prior))
    return (LEVELS + 1 - np.clip(np.rint(-logs / _steps(context, prior)), 0, LEVELS)).astype(np.uint8)


def _parts(code: np.ndarray, context: np.ndarray, prior: float) -> np.ndarray:
    """The quantised c(h w) / (c(h) + prior) of codes; 0 for pairs not met."""
    return np.where(code > 0, 10.0 ** (-_steps(context, prior) * (LEVELS + 1 - code.astype(np.float64))), 0.0)


def _pair_answers(blocks: DataFrame, vocabulary: DataFrame, pair_shards: int, span: int, prior: float, folder: str) -> DataFrame:
    """Codes of each block's distinct pairs, by (``block``, ``shard``); the shards' tries are written below ``folder``."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            for shard, pairs, times, context in _cells(row, right, pair_shards, span):
                steps = np.diff(pairs, prepend=np.uint64(0))
                rows.append((shard, row["block"], packed(steps), packed(times), packed(context[_heads(pairs, span)])))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        columns = list(zip(*rows)) or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "block", "steps", "times", "contexts"])

    def meet(table: pa.Table) -> pa.Table:
        lists = [np.cumsum(unpacked(x), dtype=np.uint64) for x in table.column("steps").to_pylist()]
        counts = [np.repeat(unpacked(c), np.diff(np.append(_heads(p, span), len(p)))) for p, c in zip(lists, table.column("contexts").to_pylist())]
        pairs, first, place = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
        context = np.concatenate(counts)[first]
        times = np.zeros(len(pairs), np.uint64)
        np.add.at(times, place, np.concatenate([unpacked(x) for x in table.column("times").to_pylist()]))
        known = times > 0
        width = np.uint64(span)
        trie = BigramTrie.build(pairs[known] // width, pairs[known] % width, _codes(times[known], context[known], prior))
        files, root = open_folder(folder)
        files.create_dir(root, recursive=True)
        path = f"{root}/shard-{table.column('shard')[0].as_py():06d}-{uuid.uuid4().hex}.trie"
        trie.save(files, path)
        answers = BigramTrie.load(files, path).lookup(pairs // width, pairs % width)[place]
        replies = pa.array([packed(x) for x in _split(answers, [len(x) for x in lists])], pa.binary())
        paths = pa.array([path] * len(lists))
        return pa.table([table.column("block"), table.column("shard"), replies, paths], names=["block", "shard", "codes", "path"])

    sent = blocks.drop("words", "counts", "n_words", "n_tokens", "doc_ids").groupBy("block").cogroup(vocabulary.groupBy("block"))
    sent = sent.applyInArrow(send, "shard long, block long, steps binary, times binary, contexts binary")
    return sent.groupBy("shard").applyInArrow(meet, "block long, shard long, codes binary, path string")


def in_training(doc_id: Column) -> Column:
    """Six sevenths of the documents, by a check sum of the id (null: the empty text's)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def scores(docs: DataFrame, train: Column | None = None, prior: float = PRIOR) -> DataFrame:
    """Log10 probabilities of all documents' texts by a model of those for which ``train`` holds.

    Words are parted by ASCII white space, A-Z lower-cased; the end of a text is one more token.  One row
    per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known`` (tokens met in training),
    ``train_tokens`` (of all training documents), ``base_score`` (add-one unigrams) and ``score``.

    Null and empty texts are their end alone.  Repeated rows give repeated results and count as often in
    training.  Without training documents every token is unknown, and of probability one in the base.
    An empty table gives no rows.  Other columns are read only for ``train``.
    """
    train = in_training(F.col("doc_id")) if train is None else F.coalesce(train, F.lit(False))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    blocks = _blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, train.alias("train")))
    size = blocks.agg(F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens")).first()
    word_shards, pair_shards = shard_count(size["words"] or 0), shard_count(size["tokens"] or 0)
    vocabulary = _vocabulary(blocks, word_shards)
    totals = vocabulary.agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens"), F.max("top").alias("top")).first()
    n_types, n_tokens, span = totals["types"] or 0, totals["tokens"] or 0, (totals["top"] or 0) + 1
    if span >= 1 << 31:
        raise ValueError(f"{span} word numbers; pairs of them need more than 63 bits")
    folder = scratch_path(docs.sparkSession, "lm-trie")
    answers = _pair_answers(blocks, vocabulary, pair_shards, span, prior, folder)

    words = vocabulary.select("block", F.lit(False).alias("paired"), "shard", "numbers", "counts", F.lit(None).cast("binary").alias("codes"))
    nothing = F.lit(None).cast("binary")
    codes = answers.select("block", F.lit(True).alias("paired"), "shard", nothing.alias("numbers"), nothing.alias("counts"), "codes")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        paired = right.column("paired")
        vocabulary, pair_codes = right.filter(pa.compute.invert(paired)), right.filter(paired)
        for row in left.to_pylist():
            numbers, counts = _looked_up(row, vocabulary)
            tokens, places, keys = _pairs(row, numbers, span)
            pairs = np.unique(keys)
            heads = _heads(pairs, span) if len(pairs) else np.zeros(0, np.int64)
            order = np.argsort(numbers)
            context = counts[order[np.searchsorted(numbers[order], pairs[heads] // np.uint64(span))]] if len(heads) else np.zeros(0, np.uint64)
            context = np.repeat(context, np.diff(np.append(heads, len(pairs))))
            parts = [(s, unpacked(c)) for s, c in zip(pair_codes.column("shard").to_pylist(), pair_codes.column("codes").to_pylist())]
            owners = _pair_shard(pairs, span, context >= HOT)
            code = gathered(parts, owners, pair_shards, np.uint8)[np.searchsorted(pairs, keys)] if len(pairs) else np.zeros(0, np.uint8)

            sizes = unpacked(row["sizes"]).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            count = counts[tokens].astype(np.float64)
            base = np.log10((count + 1) / (n_tokens + (n_types + 1)))
            before = np.concatenate([[0.0], count[:-1]])
            before[starts] = 0.0
            probability = prior / (before + prior) * (count + 1) / (n_tokens + n_types + 1)
            probability[places] += _parts(code, before[places], prior)
            score = np.log10(np.minimum(probability, 1.0))
            held_out = ~np.frombuffer(row["train"], bool)
            sums = [np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), base, score)]
            out.append(pa.table([
                pa.array(row["doc_ids"], pa.int64()), pa.array(held_out), pa.array(sizes), pa.array(sums[0]),
                pa.array(np.full(len(sizes), n_tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2]),
            ], names=names))
        return pa.concat_tables(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    whole = blocks.drop("words", "counts", "n_words", "n_tokens")
    return whole.groupBy("block").cogroup(words.union(codes).groupBy("block")).applyInArrow(finish, schema)
