"""Elias-Fano sequences and files of arrays, for the n-gram trie of operator 11.

A monotone sequence keeps the low bits of its values packed, and the high bits
in unary as one bit array; ones before each 64-bit word are summed when it is
opened.  Access, and the search for the first value that isn't below another,
work on the packed form, for many positions or values at once.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from .spans import U64
from .token_files import file_system

# Masks of 1, 2 and 4 of a byte's bits in turn, the lowest and the highest bit of each byte.
ODD, PAIRS, HALVES, LOWEST, HIGHEST = (U64(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))

CHUNK = 32768  # values that are searched together, so that what a search makes stays in the processor's cache


def _select_table() -> np.ndarray:
    """Position of the r-th set bit of a byte, at 8 * byte + r."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    table = np.zeros((256, 8), np.int64)
    for byte in range(256):
        at = np.flatnonzero(bits[byte])
        table[byte, :len(at)] = at
    return table.ravel()


_SELECT = _select_table()


class EliasFano:
    """``values``: ascending uint64; kept as arrays ``low`` and ``high`` and the numbers (n, low bits)."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self.mask = U64((1 << bits) - 1)
        self.ones = np.zeros(len(high) + 1, np.int64)
        np.cumsum(np.bitwise_count(high), out=self.ones[1:])
        self.zeros = np.arange(len(high) + 1) * 64 - self.ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(U64, copy=False)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = min(63, max(0, ((top + 1) // max(1, n)).bit_length() - 1))
        low = np.zeros((n * bits + 63) // 64 + 1, U64)
        if n and bits:
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(U64)
            part = values & U64((1 << bits) - 1)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero(shift.astype(np.int64) + bits > 64)
            low[word[over] + 1] |= part[over] >> (U64(64) - shift[over])
        length = n + (top >> bits) + 1
        high = np.zeros(-(-length // 64), U64)
        if n:
            at = (values >> U64(bits)).astype(np.int64) + np.arange(n)
            word = at >> 6
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            high[word[first]] = np.bitwise_or.reduceat(U64(1) << (at & 63).astype(U64), first)
        return cls(n, bits, low, high)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.n": np.array([self.n, self.bits])}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = arrays[f"{name}.n"].tolist()
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"])

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the one (or zero) of each rank, counted from 0."""
        before = self.ones if ones else self.zeros
        word = np.searchsorted(before, rank, side="right") - 1
        bits = self.high[word] if ones else ~self.high[word]
        rest = (rank - before[word]).astype(U64)
        sums = bits - ((bits >> U64(1)) & ODD)
        sums = (sums & PAIRS) + ((sums >> U64(2)) & PAIRS)
        sums = ((sums + (sums >> U64(4))) & HALVES) * LOWEST  # of the byte and those below it
        more = ((sums | HIGHEST) - (rest + U64(1)) * LOWEST) & HIGHEST  # marks bytes whose sum is over rest
        place = (8 - np.bitwise_count(more).astype(np.int64)) * 8
        shift = place.astype(U64)
        rest -= ((sums << U64(8)) >> shift) & U64(255)
        return word * 64 + place + _SELECT[((bits >> shift) & U64(255)).astype(np.int64) * 8 + rest.astype(np.int64)]

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), U64)
        bit = at * self.bits
        word, shift = bit >> 6, (bit & 63).astype(U64)
        more = np.where(shift > 0, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return ((self.low[word] >> shift) | more) & self.mask

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values (uint64) at the positions ``at``, all below n."""
        if not len(at):
            return np.zeros(0, U64)
        return ((self._select(at, True) - at).astype(U64) << U64(self.bits)) | self._low(at)

    def all(self) -> np.ndarray:
        return self.get(np.arange(self.n))

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first value not below each of ``values``, whether it equals it)."""
        where, equal = np.full(len(values), self.n, np.int64), np.zeros(len(values), bool)
        for at in range(0, len(values) if self.n else 0, CHUNK):
            where[at:at + CHUNK], equal[at:at + CHUNK] = self._find(values[at:at + CHUNK])
        return where, equal

    def _find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where, equal = np.full(len(values), self.n, np.int64), np.zeros(len(values), bool)
        top = (values >> U64(self.bits))
        n_zeros = len(self.high) * 64 - self.n
        inside = np.flatnonzero(top < U64(n_zeros))
        top, low = top[inside].astype(np.int64), values[inside] & self.mask
        # the values with these high bits are the run of ones after the zero before
        spot = np.where(top > 0, self._select(np.maximum(top - 1, 0), False) + 1, 0)
        begin = spot - top
        word, shift = spot >> 6, (spot & 63).astype(U64)
        rest = ~(self.high[np.minimum(word, len(self.high) - 1)] >> shift)
        run = np.bitwise_count((rest & (~rest + U64(1))) - U64(1)).astype(np.int64)
        stop = begin + run
        cut = np.flatnonzero((run >= 64 - (spot & 63)) | (word >= len(self.high)))  # runs that leave their word
        stop[cut] = self._select(top[cut], False) - top[cut]
        begin, stop = np.minimum(begin, self.n), np.minimum(stop, self.n)
        end = stop.copy()
        open_ = np.flatnonzero(begin < stop)  # binary search among the values with the same high bits
        while len(open_):
            mid = (begin[open_] + stop[open_]) >> 1
            below = self._low(mid) < low[open_]
            begin[open_[below]] = mid[below] + 1
            stop[open_[~below]] = mid[~below]
            open_ = open_[begin[open_] < stop[open_]]
        where[inside] = begin
        there = np.flatnonzero(begin < end)
        equal[inside[there]] = self._low(begin[there]) == low[there]
        return where, equal


class ChildLists:
    """Ascending child numbers of consecutive nodes, each list relative to where the one before ended."""

    def __init__(self, starts: EliasFano, values: EliasFano):
        self.starts, self.values = starts, values

    @classmethod
    def build(cls, node: np.ndarray, child: np.ndarray, n_nodes: int) -> ChildLists:
        """``node`` ascending, ``child`` ascending and distinct within a node."""
        starts = np.searchsorted(node, np.arange(n_nodes + 1))
        held = np.flatnonzero(np.diff(starts))
        last = child[starts[held + 1] - 1].astype(np.int64) + 1
        base = np.zeros(n_nodes, np.int64)
        base[held] = np.cumsum(last) - last
        return cls(EliasFano.build(starts), EliasFano.build(child + base[node] if len(node) else np.zeros(0, np.int64)))

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return self.starts.arrays(f"{name}.starts") | self.values.arrays(f"{name}.values")

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> ChildLists:
        return cls(EliasFano.of(arrays, f"{name}.starts"), EliasFano.of(arrays, f"{name}.values"))

    def find(self, node: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of ``child`` in the list of ``node``, or -1; where the list starts)."""
        if not len(node):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh = np.ones(len(node), bool)  # a list is looked up once for a run of its children
        fresh[1:] = node[1:] != node[:-1]
        node, which = node[fresh], np.cumsum(fresh) - 1
        low, high = self.starts.get(node).astype(np.int64), self.starts.get(node + 1).astype(np.int64)
        base = np.zeros(len(node), U64)
        after = np.flatnonzero((low > 0) & (low < high))
        base[after] = self.values.get(low[after] - 1) + U64(1)
        low, high, base = low[which], high[which], base[which]
        at, equal = self.values.find(base + child.astype(U64))
        return np.where(equal & (at >= low) & (at < high), at, -1), low


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> int:
    """Write named arrays one after another, 64-byte aligned; the file's size."""
    at, spots = 0, {}
    for name, a in arrays.items():
        spots[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(spots).encode()
    head = len(head).to_bytes(8, "little") + head
    head += bytes(-len(head) % 64)
    store, name = file_system(path)
    with store.open_output_stream(name) as out:
        out.write(head)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).data)
            out.write(bytes(-a.nbytes % 64))
    return len(head) + at


def mapped(path: str) -> bool:
    """Whether a file is mapped into memory, not read."""
    return file_system(path)[0].type_name == "local"


def read_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file as views: of its memory map where the store is a mounted folder, else of what was read."""
    store, name = file_system(path)
    raw = pa.memory_map(name).read_buffer() if mapped(path) else store.open_input_file(name).read_buffer()
    size = int.from_bytes(raw[:8].to_pybytes(), "little")
    base = -(-(8 + size) // 64) * 64
    spots = json.loads(raw[8:8 + size].to_pybytes())
    return {k: np.frombuffer(raw, np.dtype(kind), n, base + at) for k, (kind, n, at) in spots.items()}
