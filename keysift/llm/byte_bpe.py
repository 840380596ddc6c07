"""Byte-level BPE encoding and decoding with a pre-tokeniser that is a scan of transition functions.

Texts of a batch become one array of code points, and each code point a symbol: its class, and what
the pattern's look-ahead asks about the next ones.  A symbol is a function from the state before it
to the state after it; functions compose associatively, so all states come from a blocked prefix
scan over small integers that name functions, without a regular expression and without a loop over
characters.  Token starts are where state and symbol say so.  The slices between them are merged by
rank once per distinct slice and worker.

The pattern is the one of the public rank files: contractions, runs of letters, of numbers and of
other marks, each with at most one space before it, and white space whose last character stays
behind when text follows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from keysift.llm.tables import slices, text_only
from keysift.llm.vocab import CACHE_ENTRIES, CACHED_BYTES, byte_ranks, shipped

# Code point classes.
OTHER, LETTER, NUMBER, SPACE = range(4)
# Symbols: a letter, a number, another mark; white space before white space or the end, a space before
# text, other white space before text; an apostrophe that opens a contraction of two or three characters.
S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_JOIN, S_ALONE, S_SHORT, S_LONG = range(8)
SYMBOLS = 8
# States after a character: inside a run of letters, numbers, marks or white space, after a space that
# joins, after single white space, with one or two characters of a contraction to come, and after one.
T_LETTER, T_NUMBER, T_OTHER, T_WHITE, T_JOIN, T_ALONE, T_ONE, T_TWO, T_FRESH = range(9)
STATES = 9
# Characters per block of the scan.
BLOCK = 64
# Pieces up to this many bytes are merged in a list, longer ones by a heap.
SHORT = 48
UNRANKED = 1 << 31


def character_classes() -> np.ndarray:
    """Class of every code point, by the Unicode version of the library whose results are matched."""
    import tiktoken

    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        probe = tiktoken.Encoding(f"class{kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        members = bytes(probe.encode_ordinary(points)).decode()
        table[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """State after a symbol, and whether a token starts at it."""
    if state == T_TWO:
        return T_ONE, False
    if state == T_ONE:
        return T_FRESH, False
    after = (T_LETTER, T_NUMBER, T_OTHER, T_WHITE, T_JOIN, T_ALONE, T_ONE, T_TWO)[symbol]
    mark = symbol in (S_OTHER, S_SHORT, S_LONG)
    if state == T_OTHER and mark:
        return T_OTHER, False
    if state == T_JOIN and (mark or symbol in (S_LETTER, S_NUMBER)):
        return (T_OTHER if mark else after), False
    goes_on = (state, symbol) in ((T_LETTER, S_LETTER), (T_NUMBER, S_NUMBER), (T_WHITE, S_WHITE))
    return after, not goes_on


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Generators by symbol, composition table, result by (function, state), token start by (state, symbol).

    Symbols from SYMBOLS on stand for the first character of a text, which forgets the state.
    """
    plain = [tuple(_step(s, symbol)[0] for s in range(STATES)) for symbol in range(SYMBOLS)]
    first = [(_step(T_FRESH, symbol)[0],) * STATES for symbol in range(SYMBOLS)]
    number = {f: i for i, f in enumerate(dict.fromkeys(plain + first))}
    todo = list(number)
    generators = list(number)
    while todo:
        f = todo.pop()
        for g in generators:
            made = tuple(g[x] for x in f)
            if made not in number:
                number[made] = len(number)
                todo.append(made)
    functions = np.array(list(number), np.uint8)
    index = {f: i for f, i in number.items()}
    table = np.array([[index[tuple(g[x] for x in f)] for g in number] for f in number], np.uint16)
    starts = np.array([[_step(s, symbol)[1] for symbol in range(SYMBOLS)] + [True] * SYMBOLS for s in range(STATES)])
    return np.array([number[f] for f in plain + first], np.uint16), table, functions, starts


def _scan(f: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix compositions of the functions ``f``: within blocks side by side, then over the blocks' totals."""
    n, flat, size = len(f), table.ravel(), np.int32(len(table))
    if n <= BLOCK:
        out, acc = np.empty_like(f), None
        for i, g in enumerate(f.tolist()):
            acc = g if acc is None else int(table[acc, g])
            out[i] = acc
        return out
    rows = -(-n // BLOCK)
    padded = np.concatenate([f, np.full(rows * BLOCK - n, f[-1], f.dtype)])
    side = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    for i in range(1, BLOCK):
        side[i] = flat.take(side[i - 1].astype(np.int32) * size + side[i])
    totals = _scan(side[-1], table)
    side[:, 1:] = flat.take(totals[:-1].astype(np.int32) * size + side[:, 1:])
    return np.ascontiguousarray(side.T).reshape(-1)[:n]


def token_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pattern's matches start, in texts laid end to end; ``first`` marks each text's first character."""
    n = len(points)
    kind = classes[points]
    white = kind == SPACE
    ends = np.append(first[1:], True)
    text_follows = np.append(~white[1:], False) & ~ends
    symbols = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WHITE], np.uint8)[kind]
    ahead = white & text_follows
    symbols[ahead] = np.where(points[ahead] == 0x20, S_JOIN, S_ALONE)
    for i in np.flatnonzero(points == 0x27).tolist():
        one = chr(points[i + 1]) if not ends[i] else ""
        if one and one in "stmd":
            symbols[i] = S_SHORT
        elif one and one in "rvl" and not ends[i + 1] and one + chr(points[i + 2]) in ("re", "ve", "ll"):
            symbols[i] = S_LONG
    symbols[first] += SYMBOLS
    generators, table, functions, starts = _monoid()
    state = functions[:, T_FRESH][_scan(generators[symbols], table)]
    before = np.concatenate([np.array([T_FRESH], np.uint8), state[: n - 1]])
    return np.flatnonzero(starts[before, symbols])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the whole piece if it is a token, else the neighbours of lowest rank joined again and again."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT:
        parts = [piece[i : i + 1] for i in range(n)]
        pairs = [ranks.get(piece[i : i + 2], UNRANKED) for i in range(n - 1)]
        while pairs and (lowest := min(pairs)) < UNRANKED:
            i = pairs.index(lowest)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], UNRANKED)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], UNRANKED)
        return [ranks[p] for p in parts]
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        rank, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Codec(dict):
    """Encoder and decoder of one rank file; as a dictionary, the packed ids of pieces met before."""

    def __init__(self, content: bytes, classes: np.ndarray):
        super().__init__()
        self.ranks, self.classes = byte_ranks(content), classes
        top = max(self.ranks.values())
        self.dtype = np.dtype("<u2" if top < 65536 else "<u4")
        self.tokens = [b""] * (top + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.asarray(merge(piece, self.ranks), self.dtype).tobytes()
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        joined = "".join(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        stops = np.cumsum(lengths)
        if not joined:
            return [np.empty(0, self.dtype) for _ in texts]
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points), bool)
        first[(stops - lengths)[lengths > 0]] = True
        starts = token_starts(points, first, self.classes)
        width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
        place = np.concatenate([[0], np.cumsum(width)])
        raw = joined.encode()
        cuts = np.append(place[starts], len(raw)).tolist()
        pieces = [raw[a:b] for a, b in pairwise(cuts)]
        upto = np.searchsorted(starts, stops).tolist()
        return [np.frombuffer(b"".join(map(self.__getitem__, pieces[a:b])), self.dtype) for a, b in pairwise([0, *upto])]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in its text, and the text's length."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def _codec(content: bytes, classes: bytes) -> Codec:
    return Codec(content, np.frombuffer(classes, np.uint8))


def prepared(spark: SparkSession, path: str) -> tuple[Broadcast, Broadcast]:
    """Vocabulary and class table on every executor; two megabytes whatever the corpus."""
    return shipped(spark, path), spark.sparkContext.broadcast(character_classes().tobytes())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Ids of every text by the rank file ``path``, with the byte offset at which each token starts.

    One row per document: ``doc_id``, ``ids``, ``offsets`` (one more than ids; the last is the length
    in bytes).  Null and empty texts have no ids; repeated rows stay; other columns are not read.
    """
    content, classes = prepared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value, classes.value)
        for part in slices(batches):
            ids = codec.encode(part.column("text").to_pylist())
            lists = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([codec.offsets(x) for x in ids], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], names=["doc_id", "ids", "offsets"])

    return text_only(docs).mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Texts of ``encode``'s rows; ``start`` and ``stop`` token numbers, if such columns exist, cut a part out.

    A part that begins or ends inside a character is decoded with replacement characters.  Null ids give an empty text.
    """
    content, classes = prepared(encoded.sparkSession, path)
    cut = [c for c in ("start", "stop") if c in encoded.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value, classes.value)
        for batch in batches:
            bounds = {c: batch.column(c).to_pylist() for c in cut}
            out = []
            for i, ids in enumerate(batch.column("ids").to_pylist()):
                part = slice(*(bounds[c][i] if c in bounds else None for c in ("start", "stop")))
                out.append(codec.decode(np.asarray((ids or [])[part], np.int64)).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids", *cut).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text in one pass: number of tokens, digests of the ids and of the bytes decoded from them.

    ``ids_sha256`` is over decimal ids joined by commas.  Rows as in ``encode``; an empty text has the digests of nothing.
    """
    content, classes = prepared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value, classes.value)
        names = list(map(str, range(len(codec.tokens))))
        for part in slices(batches):
            counts, of_ids, of_bytes = [], [], []
            for ids in codec.encode(part.column("text").to_pylist()):
                listed = ids.tolist()
                counts.append(len(listed))
                of_ids.append(hashlib.sha256(",".join(map(names.__getitem__, listed)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(b"".join(map(codec.tokens.__getitem__, listed))).hexdigest())
            columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_only(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
