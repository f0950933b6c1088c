"""Bounded bitmaps of hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WORDS = 1 << 14  # 2^20 bits


def words_for(n: int) -> int:
    """64-bit words for n hashes, 16 bits each; a power of two, MAX_WORDS at most."""
    return min(MAX_WORDS, 1 << max(0, (max(1, n) * 16 - 1).bit_length() - 6))


def bitmap(hashes: DataFrame, n_words: int) -> list[int]:
    """Bits of the one long column of ``hashes``; a row per word, so n_words rows at most, come to the driver."""
    h = F.col(hashes.columns[0])
    out = [0] * n_words
    for r in hashes.select(_word(h, n_words).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), _bit(h)).alias("b")) \
            .groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        out[r["w"]] = r["b"]
    return out


def _word(h: Column, n_words: int) -> Column:
    return F.shiftright(h, 6).bitwiseAND(F.lit(n_words - 1)).cast("int")


def _bit(h: Column) -> Column:
    return h.bitwiseAND(F.lit(63)).cast("int")


def may_hold(words: list[int], h: Column) -> Column:
    """Whether the hash may be in the bitmap; a constant array, so it stays inside generated code."""
    constant = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    return F.getbit(F.element_at(constant, _word(h, len(words)) + 1), _bit(h)) == 1
