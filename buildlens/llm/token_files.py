"""Token-id shards with a minimal perfect hash index (operator 4).

``write_token_files`` encodes every text, appends an end id and writes, per
range partition of the key, two files: ``.ids`` holds the raw little-endian
ids of the partition's documents in ascending key order, ``.idx`` maps a key to
its place.  The index is a minimal perfect hash over the shard's distinct keys
(levels of bit arrays: a key that is alone at its position sets the bit, the
others go to the next level; the bit's rank is the key's slot).  Keys
themselves aren't in it: a slot stores a 32-bit fingerprint, the first record
number and the number of records of the key, so a lookup takes constant time
and a key that was never written is told by its fingerprint, but for one in
four thousand million.  Record bounds give offset and length.

A task writes under a name of its own and returns it; only the names in the
stored manifest belong to the output, so a task that is run again after an
executor was lost leaves nothing that is read.

Defined results: a null text is encoded as ''; a null key sorts first, is read
by a scan and can't be looked up; repeated keys keep all their rows, next to
each other in order of text, and a lookup returns each.  Other columns are
ignored.
"""

from __future__ import annotations

import io
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, scratch, store, table
from .spans import PieceCache, U64, blocks, mix

GAMMA = 2.0
MANIFEST = ("shard long, path string, width long, n_docs long, n_ids long, n_null long, min_key long, max_key long")
NULL_KEY = np.iinfo(np.int64).min


def file_system(uri: str):
    """(file system, path) of a folder or file, on any store that Arrow can open."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


# ---- minimal perfect hash ----

def _spot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(keys + U64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % U64(bits)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(U64) ^ U64(0xA5A5F00DC0FFEE11)) >> U64(32)).astype(np.uint32)


class KeyIndex:
    """Minimal perfect hash of distinct int64 keys: ``slots(keys)`` is 0..n-1, or anything for an unknown key."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        self.ranks = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.ranks[1:])

    @classmethod
    def build(cls, keys: np.ndarray) -> KeyIndex:
        left, sizes, words = keys.view(U64), [], []
        while len(left) and len(sizes) < 48:
            bits = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = _spot(left, len(sizes), bits)
            alone = np.bincount(at, minlength=bits) == 1
            words.append(np.packbits(alone, bitorder="little").view(U64))
            sizes.append(bits)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, U64), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(U64)
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, bits in enumerate(self.sizes.tolist()):
            at = _spot(keys[todo], level, bits) + base
            word, bit = at >> 6, (at & 63).astype(U64)
            found = (self.words[word] >> bit) & U64(1) == 1
            below = np.bitwise_count(self.words[word] & ((U64(1) << bit) - U64(1)))
            out[todo[found]] = (self.ranks[word] + below)[found]
            todo, base = todo[~found], base + bits
        if len(todo) and len(self.rest):
            place = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            same = self.rest[place] == keys[todo]
            out[todo[same]] = self.ranks[-1] + place[same]
        return out


class ShardIndex:
    """What an ``.idx`` file holds: key -> (first record, records), and the records' bounds in ids."""

    NAMES = ("sizes", "words", "rest", "prints", "first", "copies", "bounds", "keys", "nulls")

    def __init__(self, **arrays):
        self.__dict__.update(arrays)
        self.hash = KeyIndex(self.sizes, self.words, self.rest)

    @classmethod
    def build(cls, keys: np.ndarray, lens: np.ndarray, n_null: int) -> ShardIndex:
        """keys: ascending, the first n_null of them stand for null."""
        bounds = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=bounds[1:])
        known, first, copies = np.unique(keys[n_null:], return_index=True, return_counts=True)
        hashed = KeyIndex.build(known)
        slot = hashed.slots(known)
        prints, begin, many = np.zeros(len(known), np.uint32), np.zeros(len(known), np.int64), np.zeros(len(known), np.int32)
        prints[slot], begin[slot], many[slot] = fingerprint(known), first + n_null, copies
        return cls(sizes=hashed.sizes, words=hashed.words, rest=hashed.rest, prints=prints, first=begin, copies=many,
                   bounds=bounds, keys=keys, nulls=np.array([n_null], np.int64))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        for name in self.NAMES:
            np.save(out, getattr(self, name), allow_pickle=False)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> ShardIndex:
        src = io.BytesIO(raw)
        return cls(**{name: np.load(src, allow_pickle=False) for name in cls.NAMES})

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first record or -1, records) of each key."""
        slot = self.hash.slots(keys)
        if not len(self.prints):
            return np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        safe = np.where((slot >= 0) & (slot < len(self.prints)), slot, 0)
        known = (slot >= 0) & (self.prints[safe] == fingerprint(keys))
        return np.where(known, self.first[safe], -1), np.where(known, self.copies[safe], 0)


# ---- encoding ----

@lru_cache(1)
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache(2)
def _piece_cache(spec: bytes) -> PieceCache:
    """A worker's cache for one tokenizer file; the model of the tokenizers library encodes the pre-tokens."""
    from tokenizers import Tokenizer

    model, letters = Tokenizer.from_buffer(spec).model, byte_alphabet()

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [[t.id for t in model.tokenize("".join([letters[b] for b in w.encode("utf-8", "surrogatepass")]))] for w in words]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum())), lens

    return PieceCache(encode)


@lru_cache(2)
def _added(spec: bytes):
    """The file's tokenizer, and the strings of its added tokens, which it matches before any pre-token."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_buffer(spec)
    return whole, [t.content for t in whole.get_added_tokens_decoder().values() if t.content]


def encode_rows(spec: bytes, texts: pa.Array, added_as_text: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and the rows' offsets in them; the library encodes the rows that hold an added token."""
    cache = _piece_cache(spec)
    if added_as_text:
        return cache.ids(texts)
    whole, strings = _added(spec)
    held = np.zeros(len(texts), bool)
    for string in strings:
        held |= pc.fill_null(pc.match_substring(texts, string), False).to_numpy(zero_copy_only=False)
    if not held.any():
        return cache.ids(texts)
    ids, off = cache.ids(pc.if_else(pa.array(held), pa.scalar("", texts.type), texts))
    rows, lens = np.flatnonzero(held), np.diff(off)
    own = [whole.encode(t, add_special_tokens=False).ids for t in texts.take(pa.array(rows)).to_pylist()]
    lens[rows] = [len(x) for x in own]
    ids = np.insert(ids, np.repeat(off[rows], lens[rows]), np.array([i for x in own for i in x], np.uint32))
    return ids, np.concatenate([[0], np.cumsum(lens)])


def _width(spec: bytes, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_buffer(spec).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text",
                      end_id: int = 2, shards: int | None = None, added_as_text: bool = True) -> DataFrame:
    """Write the shards of ``docs`` below ``folder``; returns the stored manifest, a row per shard.

    ``tokenizer`` is a byte-level BPE file of the tokenizers library.  The
    strings of its added tokens in a text are ordinary text, or with
    ``added_as_text=False`` become those tokens, as the library's own encode has it.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        spec = f.read()
    width = _width(spec, end_id)
    shared = spark.sparkContext.broadcast(spec)  # one vocabulary file
    ranged = (docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
              .repartitionByRange(shards or partitions(spark), "key").sortWithinPartitions("key", "text"))

    def write(batches):
        keys, lens, n_ids, n_null = [], [], 0, 0
        store_fs, base = file_system(folder)
        store_fs.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        with store_fs.open_output_stream(f"{base}/{name}.ids") as out:
            for batch in batches:
                k = batch.column("key")
                n_null += k.null_count
                keys.append(k.fill_null(int(NULL_KEY)).to_numpy(zero_copy_only=False))
                for _, part in blocks(batch.column("text")):
                    ids, off = encode_rows(shared.value, part, added_as_text)
                    n = np.diff(off) + 1
                    ids = np.insert(ids, off[1:], np.uint32(end_id))
                    out.write(ids.astype("<u2" if width == 2 else "<u4").tobytes())
                    lens.append(n)
                    n_ids += len(ids)
        if not keys or not n_ids:
            store_fs.delete_file(f"{base}/{name}.ids")
            return
        index = ShardIndex.build(np.concatenate(keys), np.concatenate(lens), n_null)
        with store_fs.open_output_stream(f"{base}/{name}.idx") as out:
            out.write(index.to_bytes())
        real = index.keys[n_null:]
        from pyspark import TaskContext

        yield pa.RecordBatch.from_pylist([{
            "shard": TaskContext.get().partitionId(), "path": f"{folder}/{name}", "width": width,
            "n_docs": len(index.keys), "n_ids": n_ids, "n_null": n_null,
            "min_key": int(real[0]) if len(real) else None, "max_key": int(real[-1]) if len(real) else None}],
            schema=pa.schema([(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in MANIFEST.split(", ")]))

    return store(ranged.mapInArrow(write, MANIFEST), "token-manifest")


# ---- reading ----

def _open(path: str, suffix: str):
    store_fs, base = file_system(path)
    return store_fs.open_input_file(base + suffix)


def _index(path: str) -> ShardIndex:
    with _open(path, ".idx") as f:
        return ShardIndex.from_bytes(f.read())


def _shards(manifest: DataFrame) -> list[dict]:
    """The manifest's rows in key order with each shard's global start (as many as partitions were written)."""
    out, start = [], 0
    for r in sorted((x.asDict() for x in manifest.collect()), key=lambda r: r["shard"]):
        out.append(r | {"start": start})
        start += r["n_ids"]
    return out


def scan_token_files(manifest: DataFrame, block: int = 1 << 21) -> DataFrame:
    """Every record of the shards, found through the index: key, start, n_tokens, ids_crc32."""
    spark, rows = manifest.sparkSession, _shards(manifest)
    schema = "key long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    parts = spark.createDataFrame([(r["path"], r["width"], r["start"]) for r in rows], "path string, width long, start long")

    def read(frames):
        for frame in frames:
            for r in frame.itertuples():
                index = _index(r.path)
                n_null, bounds, keys = int(index.nulls[0]), index.bounds, index.keys
                with _open(r.path, ".ids") as f:
                    at = 0
                    while at < len(keys):
                        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + block, side="right")) - 1)
                        ids = np.frombuffer(f.read(int(bounds[stop] - bounds[at]) * int(r.width)), f"<u{r.width}").astype("<u4")
                        record = np.arange(at, stop)
                        first, copies = index.find(keys[at:stop])
                        lost = (record >= n_null) & ~((first <= record) & (record < first + copies))
                        if lost.any():
                            raise ValueError(f"{r.path}: the index doesn't lead to record {record[lost][0]}")
                        view, cut = memoryview(ids).cast("B"), ((bounds[at:stop + 1] - bounds[at]) * 4).tolist()
                        yield pd.DataFrame({
                            "key": pd.array(np.where(record < n_null, 0, keys[at:stop]), "Int64").copy(),
                            "null": record < n_null, "start": bounds[at:stop] + r.start, "n_tokens": np.diff(bounds[at:stop + 1]),
                            "ids_crc32": [zlib.crc32(view[a:b]) for a, b in zip(cut, cut[1:], strict=False)]})
                        at = stop

    out = parts.repartition(len(rows)).mapInPandas(read, f"{schema}, null boolean")
    return out.select(F.when(~F.col("null"), F.col("key")).alias("key"), "start", "n_tokens", "ids_crc32")


def lookup(manifest: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keyed access: (key, record, start, ids) for each record of each wanted key; unknown and null keys give none."""
    rows = _shards(manifest)
    spark = manifest.sparkSession
    schema = "key long, record long, start long, ids array<long>"
    rows = [r for r in rows if r["min_key"] is not None]
    if not rows:
        return spark.createDataFrame([], schema)
    lows, highs = np.array([r["min_key"] for r in rows]), np.array([r["max_key"] for r in rows])

    def read(frames):
        at, index = None, None
        for frame in frames:
            keys = np.sort(frame["key"].to_numpy(np.int64))
            spot = np.searchsorted(highs, keys)
            ok = spot < len(highs)
            keys, spot = keys[ok], spot[ok]
            keys, spot = keys[lows[spot] <= keys], spot[lows[spot] <= keys]
            for s in np.unique(spot):
                if at != s:
                    at, index = s, _index(rows[s]["path"])
                asked = keys[spot == s]
                first, copies = index.find(asked)
                with _open(rows[s]["path"], ".ids") as f:
                    for k, begin, n in zip(asked.tolist(), first.tolist(), copies.tolist(), strict=True):
                        for record in range(begin, begin + n):
                            a, b = int(index.bounds[record]), int(index.bounds[record + 1])
                            width = rows[s]["width"]
                            f.seek(a * width)
                            ids = np.frombuffer(f.read((b - a) * width), f"<u{width}").astype(np.int64)
                            yield pd.DataFrame({"key": [k], "record": [record], "start": [a + rows[s]["start"]], "ids": [ids]})

    keys = wanted.select(F.col(key).cast("long").alias("key")).filter("key is not null")
    return keys.repartitionByRange(partitions(spark), "key").mapInPandas(read, schema)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(table(spark, sf_dir, "documents"), scratch(spark, "tokens"),
                                 public_tokenizers.path("byte_bpe_50k.json"), added_as_text=False)
    return scan_token_files(manifest).withColumnRenamed("key", "doc_id")


QUERIES = {"op4_token_files": op4_token_files}
ORACLES: dict[str, str] = {}
