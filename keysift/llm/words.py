"""Words of texts as byte strings, and numbers for them."""

from __future__ import annotations

from itertools import pairwise

import numpy as np

# A-Z in lower case; digits, a-z and everything beyond ASCII belong to words; the rest parts them.
ALNUM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def alnum_words(raw: bytes) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all characters beyond ASCII."""
    return raw.translate(ALNUM).split()


def lower_words(raw: bytes) -> list[bytes]:
    """Words parted by ASCII white space, A-Z lower-cased."""
    return raw.lower().split()


class Numbering(dict):
    """Numbers for words in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def suffix_array(values: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of ``values`` by their first ``depth`` elements at least, by prefix doubling; and their ranks.

    Suffixes alike that far share a rank and stand in the order of their positions.
    """
    n = len(values)
    order = np.argsort(values, kind="stable")
    rank = np.zeros(n, np.int64)
    step = 1
    ordered = values[order]
    new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if n else np.zeros(0, np.int64)
    rank[order] = new
    while step < depth and n and new[-1] < n - 1:
        key = (rank + 1) * (n + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank[order] = new
        step *= 2
    return order, rank


def spans_of(covered: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true values, as start and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return list(pairwise(edges.tolist()))[::2]
