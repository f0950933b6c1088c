"""Vectorised text helpers for Arrow batches: blocks of rows, spans, span hashes.

A block is a few rows of a string column as one numpy array with the rows'
offsets in it.  Functions here never look at more than one block, whose size
is bounded by ``block`` bytes or by the one longest text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (two xor-multiply rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_COEFF = np.zeros(0, U64)


def coefficients(n: int) -> np.ndarray:
    """The first n coefficients of the multilinear hash: odd 64-bit values of a counter."""
    global _COEFF
    if len(_COEFF) < n:
        _COEFF = mix(np.arange(1, max(n, 256, 2 * len(_COEFF)) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    return _COEFF


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of units[s:e] for disjoint ascending spans; multilinear, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    total = int(lens.sum())
    first = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    at = np.arange(total, dtype=np.int64) - np.repeat(first, lens)
    picked = units if total == len(units) else units[at + np.repeat(starts, lens)]
    terms = (picked.astype(U64) + U64(1)) * coefficients(int(lens.max()))[at]
    return mix(np.add.reduceat(terms, first) + lens.astype(U64) * U64(0xD6E8FEB86659FD93))


def blocks(texts: pa.Array, block: int = 1 << 20):
    """(first row, rows as an Arrow array) for runs of rows of about ``block`` bytes; nulls become ''."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        done = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, done + block, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes and their offsets (rows + 1)."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def code_points(texts: pa.Array) -> tuple[str, np.ndarray, np.ndarray]:
    """All rows as one string, its code points, and the rows' offsets in them."""
    raw, off = utf8(texts)
    joined = raw.tobytes().decode("utf-8", "surrogatepass")
    units = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(units) == len(raw):
        return joined, units, off
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    return joined, units, lead[off]


OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point, by the regex library's \\p{L}, \\p{N} and \\s."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    low, high = "".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for base, text in ((0, low), (0xE000, high)):
            for m in regex.finditer(pattern, text):
                table[base + m.start():base + m.end()] = kind
    return table


def pretoken_starts(units: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Start flags of the byte-level pre-tokens, for rows tiled by ``off``.

    The pattern's alternatives become boundary rules on runs of one character
    class: a run starts a pre-token; a white-space run before other text gives
    up its last character, which joins the next run if it is U+0020; and an
    apostrophe that starts a pre-token takes the s, t, m, d, re, ve or ll
    that follow it, which then end before the rest of the letters.
    """
    n = len(units)
    if not n:
        return np.zeros(0, bool)
    kind = char_classes()[units]
    row_start = np.zeros(n + 1, bool)
    row_start[off] = True
    run = np.empty(n + 1, bool)
    run[0] = run[n] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:n])
    run |= row_start
    start = run[:n].copy()
    # the last character of a white-space run that has text after it in its row
    last = run[1:] & (kind == SPACE) & ~row_start[1:]
    start |= last
    gives = np.flatnonzero(last & (units == 0x20)) + 1
    start[gives] = False
    # contractions
    quote = np.flatnonzero((units == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~row_start[quote + 1]]
    if len(quote):
        c1 = units[quote + 1]
        c2 = np.where((quote + 2 < n) & ~row_start[np.minimum(quote + 2, n)], units[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for pair in ("re", "ve", "ll"):
            two |= (c1 == ord(pair[0])) & (c2 == ord(pair[1]))
        took = np.where(one, 1, np.where(two, 2, 0))
        hit = took > 0
        quote, took = quote[hit], took[hit]
        start[quote + 1] = False
        after = quote + 1 + took
        start[after[after < n]] = True
    return start


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[s:s+len] of all spans, concatenated."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    first = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    return flat[np.repeat(starts - first, lens) + np.arange(total, dtype=np.int64)]


class PieceCache:
    """Ids of the distinct pre-tokens that a task has met, by their 64-bit hash.

    ``encode(list of str) -> (ids, lens)`` is asked once for each new
    pre-token.  The cache is emptied when it holds ``limit`` of them.
    """

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self):
        self.at: dict[int, int] = {}
        self.start = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows (uint32) and the rows' offsets in them."""
        joined, units, off = code_points(texts)
        if not len(units):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        starts = np.flatnonzero(pretoken_starts(units, off))
        ends = np.append(starts[1:], len(units))
        keys, first, which = np.unique(span_hashes(units, starts, ends), return_index=True, return_inverse=True)
        if len(self.at) > self.limit:
            self.clear()
        known = self.at
        code = np.fromiter((known.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        new = np.flatnonzero(code < 0)
        if len(new):
            s, e = starts[first[new]].tolist(), ends[first[new]].tolist()
            ids, lens = self.encode([joined[a:b] for a, b in zip(s, e, strict=True)])
            base = len(self.len)
            code[new] = base + np.arange(len(new))
            known.update(zip(keys[new].tolist(), range(base, base + len(new)), strict=True))
            begin = np.zeros(len(lens), np.int64)
            np.cumsum(lens[:-1], out=begin[1:])
            self.start = np.append(self.start, begin + len(self.flat))
            self.len = np.append(self.len, lens)
            self.flat = np.append(self.flat, ids)
        each = code[which]
        lens = self.len[each]
        out = gather(self.flat, self.start[each], lens)
        upto = np.zeros(len(each) + 1, np.int64)
        np.cumsum(lens, out=upto[1:])
        return out, upto[np.searchsorted(starts, off)]
