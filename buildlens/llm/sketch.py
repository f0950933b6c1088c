"""Bit filters over 64-bit hashes, built by Spark in slabs and of a bounded size.

A filter is cut into slabs of 2^22 bits.  Tasks send, per slab, the positions
that their hashes set; the task that gets a slab counts them.  The finished
bits (``MAX_SLABS`` slabs, 32 MB, at most) come to the driver and are
broadcast.  With more hashes the bits fill up and the filter lets more
through; nothing is ever held back that it should let through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .spans import U64

SLAB = 1 << 22
MAX_SLABS = 64
POSITIONS = "slab int, spots binary"


def slabs_for(n: int, bits_each: int = 16) -> int:
    return int(min(MAX_SLABS, max(1, -(-n * bits_each // SLAB))))


def places(hashes: np.ndarray, n_slabs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slab of each hash and its two positions there."""
    low = U64(SLAB - 1)
    return ((hashes >> U64(44)) % U64(n_slabs)).astype(np.int64), (hashes & low).astype(np.uint32), \
        ((hashes >> U64(22)) & low).astype(np.uint32)


def positions(hashes: np.ndarray, n_slabs: int, most: int = 2) -> pa.RecordBatch:
    """A batch of POSITIONS rows for some insertions; one hash counts ``most`` times at most."""
    known, times = np.unique(hashes, return_counts=True)
    slab, one, two = places(np.repeat(known, np.minimum(times, most)), n_slabs)
    order = np.argsort(slab, kind="stable")
    cut = np.searchsorted(slab[order], np.arange(n_slabs + 1))
    rows = [s for s in range(n_slabs) if cut[s] < cut[s + 1]]
    return pa.RecordBatch.from_arrays([
        pa.array(rows, pa.int32()),
        pa.array([np.concatenate([one[order[cut[s]:cut[s + 1]]], two[order[cut[s]:cut[s + 1]]]]).tobytes() for s in rows], pa.binary())],
        ["slab", "spots"])


class BitFilter:
    def __init__(self, bits: np.ndarray):
        self.bits = bits  # slabs x bytes

    def __contains__(self, value: int) -> bool:
        return bool(self.test(np.array([value], U64))[0])

    def test(self, hashes: np.ndarray) -> np.ndarray:
        slab, one, two = places(hashes, len(self.bits))
        hit = lambda p: (self.bits[slab, p >> np.uint32(3)] >> (p & np.uint32(7)).astype(np.uint8)) & 1
        return (hit(one) & hit(two)).astype(bool)


def build_filter(rows: DataFrame, n_slabs: int, at_least: int) -> BitFilter:
    """The bits that ``at_least`` insertions have set; ``rows`` are POSITIONS."""

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((at_least, SLAB // 8), np.uint8)  # seen[i]: bits set more than i times
        held, n = [], 0

        def add() -> None:
            spot, times = np.unique(np.concatenate(held), return_counts=True)
            fresh = [np.packbits(np.bincount(spot[times > i], minlength=SLAB).astype(bool), bitorder="little") for i in range(at_least)]
            if at_least == 2:  # seen twice: here, or here and before
                seen[1] |= fresh[1] | (seen[0] & fresh[0])
            seen[0] |= fresh[0]
            held.clear()

        for batch in batches:
            for spots in batch.column("spots"):
                held.append(np.frombuffer(spots.as_buffer(), np.uint32))
                n += len(held[-1])
                if n > 2_000_000:
                    add()
                    n = 0
        if held:
            add()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([seen[-1].tobytes()], pa.binary())],
                                         ["slab", "bits"])

    if at_least not in (1, 2):
        raise ValueError("a filter is of what was seen once or twice")
    bits = np.zeros((n_slabs, SLAB // 8), np.uint8)
    for row in rows.groupBy("slab").applyInArrow(count, "slab int, bits binary").collect():  # MAX_SLABS rows at most
        bits[row["slab"]] = np.frombuffer(row["bits"], np.uint8)
    return BitFilter(bits)
