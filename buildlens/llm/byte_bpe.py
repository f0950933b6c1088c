"""Byte-level BPE encoding and decoding by merge ranks (operator 5).

Pre-tokens come from boundary rules over whole blocks of text (``spans``).  The
distinct ones are bucketed by length and put into padded matrices of token
ids, one row each.  In every round each row looks up the ranks of its adjacent
pairs in a hash table of pairs, merges the leftmost pair of the lowest rank,
and closes the gap; finished rows leave the matrix.  Ranks are kept beside the
ids, so a round looks up only the two pairs that the merge changed.

Defined results: a null text has no ids and decodes to empty bytes; repeated
rows are encoded alike; a text of any length is encoded whole, and a pre-token
of any length is a row of its own bucket.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy
from .spans import PieceCache, U64, blocks, gather, mix

NONE = np.uint32(0xFFFFFFFF)
CELLS = 1 << 19  # ids in one matrix


class PairTable:
    """Open-addressed hash table from a pair of ids to the rank that the pair merges to."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = np.array(left, U64) << U64(32) | np.array(right, U64)
        self.mask = (1 << max(4, int(4 * len(keys)).bit_length())) - 1
        self.keys = np.full(self.mask + 1, 0xFFFFFFFFFFFFFFFF, U64)
        self.rank = np.full(self.mask + 1, NONE, np.uint32)
        todo, at = np.arange(len(keys)), self._home(keys)
        rank = np.array(rank, np.uint32)
        while len(todo):
            free = self.keys[at] == U64(0xFFFFFFFFFFFFFFFF)
            spot, who = np.unique(at[free], return_index=True)
            who = np.flatnonzero(free)[who]
            self.keys[spot], self.rank[spot] = keys[todo[who]], rank[todo[who]]
            stay = np.ones(len(todo), bool)
            stay[who] = False
            todo, at = todo[stay], (at[stay] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) & U64(self.mask)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where they don't merge, or one side is NONE."""
        keys = left.astype(U64) << U64(32) | right.astype(U64)
        at = self._home(keys)
        out, todo = np.full(len(keys), NONE, np.uint32), np.arange(len(keys))
        while len(todo):
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.rank[at[hit]]
            more = ~hit & (held != U64(0xFFFFFFFFFFFFFFFF))
            todo, at = todo[more], (at[more] + 1) & self.mask
        return out


class Bpe:
    """A vocabulary of merge ranks: ``encode`` lists of pre-tokens, ``decode`` ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pairs = PairTable(ranks)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.uint32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, r in ranks.items():
            tokens[r] = token
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per word)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        out = np.full(len(flat), NONE, np.uint32)  # a word's ids stand where its bytes were
        lens = np.zeros(len(raw), np.int64)
        order = np.argsort(size, kind="stable")
        i = int(np.searchsorted(size[order], 0, side="right"))
        while i < len(order):
            width = int(size[order[i]])
            if width > 16:  # lengths within an eighth of each other share a bucket
                width += -width % (1 << (width.bit_length() - 3))
            stop = min(int(np.searchsorted(size[order], width, side="right")), i + max(1, CELLS // width))
            self._bucket(flat, at, size, order[i:stop], width, out, lens)
            i = stop
        return out[out != NONE], lens

    def _bucket(self, flat, at, size, rows, width, out, lens) -> None:
        cols = np.arange(width)
        inside = cols < size[rows][:, None]
        ids = np.full((len(rows), width), NONE, np.uint32)
        ids[inside] = self.byte_id[flat[(at[rows][:, None] + cols)[inside]]]
        rank = np.full((len(rows), width), NONE, np.uint32)  # of the pair that starts here
        if width > 1:
            rank[:, :-1] = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while len(rows):
            spot = rank.argmin(axis=1)
            line = np.arange(len(rows))
            best = rank[line, spot]
            done = best == NONE
            if done.any():
                n = (ids[done] != NONE).sum(axis=1)
                which = rows[done]
                lens[which] = n
                total = np.arange(ids.shape[1]) < n[:, None]
                out[(at[which][:, None] + np.arange(ids.shape[1]))[total]] = ids[done][total]
                keep = ~done
                rows, ids, rank, spot, best = rows[keep], ids[keep], rank[keep], spot[keep], best[keep]
                if not len(rows):
                    return
                line = np.arange(len(rows))
            # merge, then close the gap: everything right of the merged pair moves one left
            ids[line, spot] = best
            stay = np.arange(ids.shape[1]) != spot[:, None] + 1
            w = ids.shape[1] - 1
            ids, rank = ids[stay].reshape(len(rows), w), rank[stay].reshape(len(rows), w)
            here = spot
            right = np.where(here + 1 < w, ids[line, np.minimum(here + 1, w - 1)], NONE)
            rank[line, here] = self.pairs(ids[line, here], right)
            back = here > 0
            if back.any():
                rank[line[back], here[back] - 1] = self.pairs(ids[line[back], here[back] - 1], ids[line[back], here[back]])

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_bytes, self.token_at[ids], self.token_len[ids]).tobytes()


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


@lru_cache(2)
def _bpe(raw: bytes) -> tuple[Bpe, PieceCache]:
    bpe = Bpe(read_ranks(raw))
    return bpe, PieceCache(bpe.encode)


def _ranks(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # one vocabulary file


def _append(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), column], [*kept, name])


def encode_documents(docs: DataFrame, ranks: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` by the rank file ``ranks`` as array<int>; replaces a column of that name."""
    shared = _ranks(docs.sparkSession, ranks)
    kept = [f for f in docs.schema.fields if f.name != ids]

    @tidy
    def encode(batches):
        cache = _bpe(shared.value)[1]
        for batch in batches:
            for at, part in blocks(batch.column(text)):
                flat, off = cache.ids(part)
                column = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.view(np.int32)))
                yield _append(batch.slice(at, len(part)), ids, column)

    from pyspark.sql import types as T

    return docs.select(*(f"`{f.name}`" for f in kept)).mapInArrow(encode, T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))])) \
        if text != ids else _same_name(docs, ranks, text)


def _same_name(docs: DataFrame, ranks: str, text: str) -> DataFrame:
    out = encode_documents(docs, ranks, text, f"{text}__ids")
    return out.drop(text).withColumnRenamed(f"{text}__ids", text)


def decode_documents(docs: DataFrame, ranks: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that ``ids`` stand for as binary; a null list decodes to empty bytes."""
    shared = _ranks(docs.sparkSession, ranks)
    kept = [f for f in docs.schema.fields if f.name != decoded]

    @tidy
    def decode(batches):
        bpe = _bpe(shared.value)[0]
        for batch in batches:
            lists = batch.column(ids)
            flat, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            step, at = 2_000_000, 0
            while at < len(lists):
                stop = max(at + 1, int(np.searchsorted(off, off[at] + step, side="right")) - 1)
                part = flat[off[at]:off[stop]]
                size = np.concatenate([[0], np.cumsum(bpe.token_len[part])])
                column = pa.Array.from_buffers(pa.binary(), stop - at, [
                    None, pa.py_buffer(size[off[at:stop + 1] - off[at]].astype(np.int32).tobytes()), pa.py_buffer(bpe.decode(part))])
                yield _append(batch.slice(at, stop - at), decoded, column)
                at = stop

    from pyspark.sql import types as T

    return docs.select(*(f"`{f.name}`" for f in kept)).mapInArrow(decode, T.StructType([*kept, T.StructField(decoded, T.BinaryType())]))


def token_digests(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, from its ids and from what they decode to."""
    if ranks is None:
        import public_tokenizers

        ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode_documents(docs.select("doc_id", "text"), ranks).drop("text")
    coded = coded.select("doc_id", F.col("ids"), F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"))
    return decode_documents(coded, ranks).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict[str, str] = {}
