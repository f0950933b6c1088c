"""Word spans of UTF-8 rows, vectorised over a block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .spans import U64, mix, span_hashes, utf8

#: White space that separates words: U+0020 and U+0009 to U+000D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def words(texts: pa.Array, separator: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased, row offsets, starts, ends, row of each word)."""
    raw, off = utf8(texts)
    raw = LOWER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    inside = ~separator[raw]
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    starts = np.flatnonzero(inside & (edge[:-1] | ~before))
    after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
    ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    return raw, off, starts, ends, np.searchsorted(off, starts, side="right") - 1


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of each row's distinct shingles, ascending in a row; rows' offsets in them).

    A row with fewer words than ``width``, but not none, has its whole sequence as one shingle.
    """
    raw, off, starts, ends, row = words(texts)
    word = span_hashes(raw, starts, ends)
    n_rows = len(off) - 1
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])
    hashes, owner = [], []
    if len(word) >= width:
        total = np.zeros(len(word) - width + 1, U64)
        for j in range(width):
            total += word[j:len(word) - width + 1 + j] * U64((0x9E3779B97F4A7C15 * (2 * j + 3) | 1) & (2**64 - 1))
        whole = row[:len(total)] == row[width - 1:]
        hashes.append(mix(total[whole]))
        owner.append(row[:len(total)][whole])
    for n in range(1, width):
        short = np.flatnonzero(count == n)
        if len(short):
            total = np.full(len(short), n, U64)
            for j in range(n):
                total += word[first[short] + j] * U64((0xC2B2AE3D27D4EB4F * (2 * j + 3) | 1) & (2**64 - 1))
            hashes.append(mix(total ^ U64(0x5851F42D4C957F2D)))
            owner.append(short)
    if not hashes:
        return np.zeros(0, U64), np.zeros(n_rows + 1, np.int64)
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(n_rows + 1))
