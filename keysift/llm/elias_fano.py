"""Elias-Fano sequences and a trie level made of them, in files that can be mapped into memory."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyarrow import fs

WIDTHS = (32, 16, 8, 4, 2, 1)


class EliasFano:
    """A non-decreasing sequence of integers: low bits in an array, high bits in unary with a directory of ones per word.

    Takes about two bits and the low part for each element; all operations work on arrays of arguments.
    """

    PARTS = ("low", "high", "ones")

    def __init__(self, n: int, shift: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.shift, self.low, self.high, self.ones = n, shift, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        # Low parts take whole bytes.
        octets = -(-bits // 8)
        low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :octets]).reshape(-1)
        shift = 8 * octets
        places = (values >> np.uint64(shift)).astype(np.int64) + np.arange(n)
        size = (top >> shift) + n + 1
        high = np.zeros(-(-size // 64) * 64, np.uint8)
        high[places] = 1
        packed = np.packbits(high, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64)
        return cls(n, shift, low, packed, ones)

    def _low(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(index), np.uint64)
        octets = self.shift // 8
        for i in range(octets):
            out |= self.low[index * octets + i].astype(np.uint64) << np.uint64(8 * i)
        return out

    def _select(self, rank: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the ``rank``-th zero or one bit of the high part."""
        before = np.arange(len(self.ones)) * 64 - self.ones if zeros else self.ones
        word = np.searchsorted(before, rank, side="right") - 1
        word = np.minimum(word, len(self.ones) - 2)
        bits = ~self.high[word] if zeros else self.high[word]
        rest, place = rank - before[word], word * 64
        for width in WIDTHS:
            count = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            beyond = rest >= count
            rest = rest - np.where(beyond, count, 0)
            place = place + np.where(beyond, width, 0)
            bits = np.where(beyond, bits >> np.uint64(width), bits)
        return place

    def access(self, index: np.ndarray) -> np.ndarray:
        """Elements at the places ``index``."""
        high = (self._select(index, zeros=False) - index).astype(np.uint64)
        return (high << np.uint64(self.shift)) | self._low(index)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Place of the first element that is at least each of ``values``; n if there is none."""
        if not self.n:
            return np.zeros(len(values), np.int64)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.shift)).astype(np.int64)
        last = len(self.high) * 64 - self.n - 1
        inside = high <= last
        bucket = np.where(inside, high, 0)
        end = np.where(inside, self._select(bucket, zeros=True) - bucket, self.n)
        begin = np.where(inside, np.where(bucket > 0, self._select(np.maximum(bucket - 1, 0), zeros=True) - bucket + 1, 0), self.n)
        end, begin = np.minimum(end, self.n), np.minimum(begin, self.n)
        if self.shift:
            wanted = values & np.uint64((1 << self.shift) - 1)
            while (open_ := begin < end).any():
                middle = (begin + end) // 2
                less = open_ & (self._low(np.minimum(middle, self.n - 1)) < wanted)
                begin = np.where(less, middle + 1, begin)
                end = np.where(open_ & ~less, middle, end)
        return begin


class BigramTrie:
    """Contexts, pointers to their successors, and the successors' quantised probabilities.

    Successors of one context ascend; added to the last element before the context's range they ascend
    throughout, so one sequence holds them all and a search is relative to its context.
    """

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.successors, self.codes = contexts, pointers, successors, codes

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, codes: np.ndarray) -> BigramTrie:
        """From pairs sorted by context and word, without repeats."""
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        stops = np.append(starts[1:], len(context))
        own = word.astype(np.uint64) + np.uint64(1)
        last = own[stops - 1] if len(starts) else own
        base = np.concatenate([[0], np.cumsum(last)[:-1]]).astype(np.uint64) if len(starts) else own
        monotone = own + np.repeat(base, stops - starts)
        pointers = EliasFano.build(np.append(starts, len(context)))
        return cls(EliasFano.build(context[starts]), pointers, EliasFano.build(monotone), codes)

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of pairs; 0 for pairs that are not there."""
        out = np.zeros(len(context), np.uint8)
        if not self.contexts.n or not len(context):
            return out
        # Pairs come sorted, so contexts are looked up once each.
        heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        own = context[heads]
        place = self.contexts.successor(own)
        known = place < self.contexts.n
        known[known] = self.contexts.access(place[known]) == own[known].astype(np.uint64)
        place = np.where(known, place, 0)
        begin, end = self.pointers.access(place).astype(np.int64), self.pointers.access(place + 1).astype(np.int64)
        base = np.where(begin > 0, self.successors.access(np.maximum(begin - 1, 0)), np.uint64(0))
        times = np.diff(np.append(heads, len(context)))
        rows = np.flatnonzero(np.repeat(known, times))
        base, end = np.repeat(base, times)[rows], np.repeat(end, times)[rows]
        target = word[rows].astype(np.uint64) + np.uint64(1) + base
        at = self.successors.successor(target)
        hit = at < end
        hit[hit] = self.successors.access(at[hit]) == target[hit]
        out[rows[hit]] = self.codes[at[hit]]
        return out

    def save(self, files: fs.FileSystem, path: str) -> None:
        head, arrays, offset = {}, [], 0
        for name in ("contexts", "pointers", "successors"):
            level: EliasFano = getattr(self, name)
            head[name] = {"n": level.n, "shift": level.shift}
            arrays += [(f"{name}.{part}", getattr(level, part)) for part in EliasFano.PARTS]
        arrays.append(("codes", self.codes))
        for name, array in arrays:
            head[name] = {"at": offset, "dtype": array.dtype.str, "size": len(array), **head.get(name, {})}
            offset += -(-array.nbytes // 64) * 64
        raw = json.dumps(head).encode()
        raw += b" " * (-(len(raw) + 8) % 64)
        with files.open_output_stream(path) as out:
            out.write(len(raw).to_bytes(8, "little") + raw)
            for _, array in arrays:
                out.write(np.ascontiguousarray(array).tobytes() + bytes(-array.nbytes % 64))

    @classmethod
    def load(cls, files: fs.FileSystem, path: str) -> BigramTrie:
        """Levels as views of the file, mapped into memory where the file system is a local or mounted one."""
        if isinstance(files, fs.LocalFileSystem):
            buffer = pa.memory_map(path).read_buffer()
        else:
            buffer = files.open_input_file(path).read_buffer()
        size = int.from_bytes(memoryview(buffer)[:8], "little")
        head = json.loads(bytes(memoryview(buffer)[8 : 8 + size]))

        def array(name: str) -> np.ndarray:
            part = head[name]
            return np.frombuffer(buffer, np.dtype(part["dtype"]), part["size"], 8 + size + part["at"])

        levels = [
            EliasFano(head[n]["n"], head[n]["shift"], *(array(f"{n}.{part}") for part in EliasFano.PARTS))
            for n in ("contexts", "pointers", "successors")
        ]
        return cls(*levels, array("codes"))
