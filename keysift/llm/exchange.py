"""Sending arrays of keys from blocks of documents to shards, and answers back.

A block is one row: some documents and what a task derived from them.  Its keys are cut by shard
(``key % shards``) and travel as one packed row for each shard they touch, so neither side handles a
Spark row per key.  Shards grow in number with the data, not in size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

# Keys that one shard is meant to hold.
SHARD_KEYS = 500_000


def shard_count(keys: int) -> int:
    return max(1, -(-int(keys) // SHARD_KEYS))


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shard and positions of its keys, in their order; the same keys always give the same positions."""
    owner = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(owner[part[0]]), part


def by_range(hashes: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Shard and part of ascending 64-bit hashes, shards being equal ranges; the parts in order are the whole."""
    owner = ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
    for start, stop in pairwise(cuts):
        if start < stop:
            yield int(owner[start]), slice(start, stop)


def gathered(answers: list[tuple[int, np.ndarray]], keys: np.ndarray, shards: int, dtype: np.dtype) -> np.ndarray:
    """The shards' answers put back to the places of ``keys``."""
    by_owner = dict(answers)
    out = np.zeros(len(keys), dtype)
    for shard, places in by_shard(keys, shards):
        out[places] = by_owner[shard]
    return out


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed planes of equal bytes, without the planes that are all zero."""
    octets = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:octets]).tobytes()
    return bytes([octets]) + len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(planes: bytes) -> np.ndarray:
    octets, n = planes[0], int.from_bytes(planes[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :octets] = np.frombuffer(pa.decompress(planes[9:], n * octets, codec="zstd"), np.uint8).reshape(octets, n).T
    return out.view("<u8").reshape(-1)
