"""Files of public tokenizers, sent to the executors, and the per-word caches that workers keep.

A vocabulary file is a couple of megabytes at most; the driver reads it from the path that is a
parameter and broadcasts its bytes, after checking that size.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

# Largest vocabulary file that is broadcast.
VOCABULARY_BYTES = 64 * 1024 * 1024
# Entries of a worker's cache of pieces, of words, of their stems, and ids that it holds; beyond these a cache starts anew, which changes no result.
CACHE_ENTRIES = 500_000
CACHED_WORDS = 800_000
CACHED_STEMS = 500_000
CACHE_IDS = 32 * 1024 * 1024
# Longest word or piece, in bytes, that is cached.
CACHED_BYTES = 64


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a vocabulary file, on every executor."""
    size = os.path.getsize(path)
    if size > VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file of {size} bytes; at most {VOCABULARY_BYTES} are broadcast")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def digest(path: str) -> str:
    """Digest of a vocabulary file, which names the tokenizer's version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=4)
def byte_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


@lru_cache(maxsize=4)
def word_encoder(content: bytes) -> WordEncoder:
    return WordEncoder(content)


class Words(dict):
    """Numbers of the words met so far; those met for the first time are listed in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []
        self.count = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.count
        self.count += 1
        self.fresh.append(word)
        return number


class WordEncoder:
    """Ids of texts by a JSON tokenizer that drops white space, one distinct word at a time.

    No token of such a tokenizer crosses white space and none of its rules looks beyond it, so the
    ids of a text are those of its words in a row.  Words are encoded by the tokenizers library;
    the ids of those already met lie end to end in one array, and a text gathers its own by word number.
    """

    # Letters that stay one pre-token whatever the library's Unicode version, and closing marks, which are another:
    # ASCII punctuation but for the apostrophe, which may begin a pre-token with letters.
    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(content)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 65536 else "<u4")
        # A pre-token is closed by the one token that carries the mark of a word's end.
        self.closes = np.zeros(size, dtype=bool)
        for token, number in self.library.get_vocab().items():
            self.closes[number] = token.endswith("</w>")
        # Whether upper case changes nothing, so that stems are kept once for both.
        self.folds = all(self._alone([a]) == self._alone([a.lower()]) for a in ("AZ", "ÀÞ", "Street"))
        self.stems: dict[str, bytes] = {}
        self.closing: dict[str, bytes] = {"": b""}
        self.forget()

    def forget(self) -> None:
        """Start the word cache anew."""
        self.words = Words()
        self.ids, self.n_ids = np.zeros(1 << 16, self.dtype), 0
        self.sizes = np.zeros(1 << 14, np.int64)
        self.starts = np.zeros(1 << 14, np.int64)

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Ids of words of letters only; they go through the library as one text, cut at word ends."""
        ids = np.asarray(self.library.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(stems) or (len(ends) and ends[-1] != len(ids)):
            return self._alone(stems)
        packed, width = ids.tobytes(), self.dtype.itemsize
        cuts = (ends * width).tolist()
        return [packed[a:b] for a, b in zip([0, *cuts], cuts)]

    def _packed(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed."""
        if len(self.stems) > CACHED_STEMS:
            self.stems = {}
        if len(self.closing) > CACHED_STEMS // 16:
            self.closing = {"": b""}
        parts: list[tuple[str, str] | None] = []
        other, stems, marks = [], set(), set()
        for raw in words:
            word = raw.decode()
            found = self.PLAIN.fullmatch(word) if len(raw) <= CACHED_BYTES else None
            if found is None:
                other.append(word)
                parts.append(None)
                continue
            stem, mark = found.groups()
            if self.folds:
                stem = stem.lower()
            if stem not in self.stems:
                stems.add(stem)
            if mark not in self.closing:
                marks.add(mark)
            parts.append((stem, mark))
        if stems:
            listed = list(stems)
            self.stems.update(zip(listed, self._stems(listed)))
        if marks:
            listed = list(marks)
            self.closing.update(zip(listed, self._alone(listed)))
        alone = iter(self._alone(other))
        return [next(alone) if p is None else self.stems[p[0]] + self.closing[p[1]] for p in parts]

    def learn(self, words: list[bytes]) -> None:
        """Put the ids of words behind those already there, in the order of their numbers."""
        packed = self._packed(words)
        width = self.dtype.itemsize
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // width
        joined = np.frombuffer(b"".join(packed), self.dtype)
        first, n = self.words.count - len(words), self.n_ids
        if n + len(joined) > len(self.ids):
            self.ids = np.concatenate([self.ids[:n], np.zeros(max(n, len(joined)) + (1 << 16), self.dtype)])
        if self.words.count > len(self.sizes):
            room = np.zeros(self.words.count + (1 << 14), np.int64)
            self.sizes, self.starts = (np.concatenate([x[:first], room]) for x in (self.sizes, self.starts))
        self.ids[n : n + len(joined)] = joined
        self.sizes[first : first + len(words)] = sizes
        self.starts[first : first + len(words)] = n + np.cumsum(sizes) - sizes
        self.n_ids = n + len(joined)

    def _numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, their ids known, and where each text's words end."""
        if len(self.words) > CACHED_WORDS or self.n_ids > CACHE_IDS:
            self.forget()
        split = [t.split() for t in texts]
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        numbers = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(ends[-1]) if len(ends) else 0)
        fresh = self.words.fresh
        if fresh:
            self.words.fresh = []
            self.learn(fresh)
            for raw in fresh:
                if len(raw) > CACHED_BYTES:
                    del self.words[raw]
        return numbers, ends

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        numbers, ends = self._numbers(texts)
        sizes = self.sizes[numbers]
        reach = np.cumsum(sizes)
        total = int(reach[-1]) if len(reach) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.starts[numbers] - (reach - sizes), sizes)]
        cuts = np.concatenate([[0], reach])[ends].tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]

    def counts(self, texts: list[bytes]) -> list[int]:
        """Number of ids of each text."""
        numbers, ends = self._numbers(texts)
        reach = np.concatenate([[0], np.cumsum(self.sizes[numbers])])[np.concatenate([[0], ends])]
        return np.diff(reach).tolist()
