"""Language-model scores from an Elias-Fano n-gram trie (operator 11).

A document's tokens are its words and one end.  The model is a trigram model
with Witten-Bell smoothing, p(c | a b) = A3 + L3 (A2 + L2 p1(c)): A is a count
over (n + t) of its context, L is t / (n + t), n the context's tokens and t its
different successors, and p1 the add-one unigram probability, which alone is
the base score.  A and L are kept as 8-bit codes of their logarithm.

The levels are compact files (``elias_fano``) below the shared checkpoint folder, which tasks
map into memory:

* the first level: word hashes, ascending, in ranges of hashes, with their exact counts.  A word's place
  is its id.  A block looks its distinct words up in order, one file after another;
* shards of the upper levels, ranges of (b, a, c) in order of ids, of about ``SHARD_BYTES`` of text each:
  per word b its successors c, with A2, and L2 of b; per word b the words a before it, with L3 of
  the context (a, b); per context its successors c, with A3, each as the rank of c among the
  successors of b, so that a trigram is found by successor searches relative to its contexts.

Range bounds come from a bounded sample and change balance only; a frequent word or context is cut across
shards.  What a bound cuts is made whole before a shard is built: the successors of the two words and
the counts of the two contexts at its ends.  So a shard answers alone, and results don't depend on
how many shards there are.

Documents are read in blocks of ``BLOCK`` bytes (or one longer text).  A block sends each shard its distinct
trigrams once, packed, with the documents that hold them; a shard's task maps the shard's file
and sends back sums per document of that block.

Nothing whole passes the driver but the range bounds, the names of the first level's files and two totals.  One task
holds one block, one shard, or the successors of one frequent word (the vocabulary at most).  Where the
store can't be mapped, one file at a time is read.

Defined results: a null text is empty; an empty text is its end alone; rows that repeat
a key or text are scored, and learned, each; a null key is never held out; with nothing
learned every probability is that of p1 with no counts, 1; an empty table gives an
empty result.  Other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scoped_conf
from .common import CLEAN_UP, partitions, scratch, store, table
from .elias_fano import ChildLists, EliasFano, mapped, read_arrays, write_arrays
from .spans import U64, blocks, mix, span_hashes
from .token_files import file_system
from .words import words

BLOCK, SHARD_BYTES, SAMPLED = 16 << 20, 16 << 20, 64  # sampled trigrams per shard
STEP = 20            # codes per power of ten
START, END = U64(0x5354415254), U64(0x454E44)
COUNTED = "kind int, shard int, k1 long, k2 long, n long, t long, path string, x binary, y binary"


# ---- codes and packed arrays ----

def codes(p: np.ndarray) -> np.ndarray:
    """8-bit codes of probabilities on a grid of their logarithm."""
    return np.clip(np.rint(-np.log10(p) * STEP), 0, 255).astype(np.uint8)


VALUES = 10.0 ** (-np.arange(256) / STEP)


def _pack(numbers: np.ndarray) -> bytes:
    """Non-negative integers in their least width, compressed."""
    top = int(numbers.max()) if len(numbers) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, U64) if top <= np.iinfo(k).max)
    raw = np.ascontiguousarray(numbers, kind).tobytes()
    return np.array([np.dtype(kind).itemsize, len(numbers)], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    width, n = np.frombuffer(raw, np.int64, 2).tolist()
    return np.frombuffer(pa.decompress(memoryview(raw)[16:], n * width, "zstd", asbytes=True), f"<u{width}")


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ascending numbers, by their differences."""
    return _pack(np.diff(ids, prepend=0))


def _unpack_ids(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw).astype(np.int64))


# ---- trigrams of a block ----

def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hash of every token, tokens of each row); each row ends with END."""
    hashes, counts = [], []
    for _, part in blocks(texts):  # a small block at a time, as hashing takes many times a text's size
        raw, _, starts, ends, row = words(part)
        count = np.bincount(row, minlength=len(part)) + 1
        out = np.full(int(count.sum()), END, U64)
        out[np.arange(len(row)) + row] = span_hashes(raw, starts, ends)
        hashes.append(out)
        counts.append(count)
    return np.concatenate(hashes or [np.zeros(0, U64)]), np.concatenate(counts or [np.zeros(0, np.int64)])


class Trigrams:
    """The distinct trigrams (a, b, c) of a block in order of (b, a, c); ids are places in ``known``, ascending hashes.

    Trigram i is that of the tokens order[first[i]:first[i + 1]]; ``doc`` is each token's row.
    """

    def __init__(self, token: np.ndarray, count: np.ndarray):
        known, c = np.unique(np.append(token, START), return_inverse=True)
        c = c.astype(np.int32)
        start, c = c[-1], c[:-1]
        first = np.cumsum(count) - count
        b, a = np.roll(c, 1), np.roll(c, 2)
        b[first] = a[first] = start
        a[first[count > 1] + 1] = start
        self.known, self.doc = known, np.repeat(np.arange(len(count), dtype=np.int32), count)
        self.b, self.a, self.c, self.order, self.first = ordered(b, a, c, len(known))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each trigram's tokens."""
        return np.add.reduceat(values[self.order].astype(np.int64), self.first[:-1]) if len(self.order) else np.zeros(0, np.int64)

    def cuts(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Places at which the shards' ranges begin and end; ``ids``: those of ``known``."""
        b = ids[self.b]
        low, high = np.searchsorted(b, bounds[:, 0], "left"), np.searchsorted(b, bounds[:, 0], "right")
        out = low.copy()
        for i in np.flatnonzero(low < high):
            a = ids[self.a[low[i]:high[i]]]
            x, y = (low[i] + np.searchsorted(a, bounds[i, 1], side) for side in ("left", "right"))
            out[i] = x + np.searchsorted(ids[self.c[x:y]], bounds[i, 2], "left")
        return np.concatenate([[0], out, [len(self.b)]])


def ordered(b: np.ndarray, a: np.ndarray, c: np.ndarray, n: int):
    """Distinct (b, a, c) of ids below n in ascending order; the order of the given ones, and where each distinct one starts in it."""
    pair = b.astype(U64) * U64(n) + a.astype(U64)
    pairs = None
    if n ** 3 >= 1 << 63:
        pairs, pair = np.unique(pair, return_inverse=True)
    key = pair.astype(U64) * U64(n) + c.astype(U64)
    del pair
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key = key[first]
    pair, c = key // U64(n), (key % U64(n)).astype(np.int32)
    if pairs is not None:
        pair = pairs[pair.astype(np.int64)]
    return (pair // U64(n)).astype(np.int32), (pair % U64(n)).astype(np.int32), c, order, np.append(first, len(order))


def _by_key(batches, of):
    """(key, rows) of a sorted stream of batches; ``of`` names the key's column."""
    last, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if held and r[of] != last:
                yield last, held
                held = []
            last = r[of]
            held.append(r)
    if held:
        yield last, held


# ---- the first level ----

class Vocabulary:
    """Files of the first level, by ranges of hashes; ids count on from file to file."""

    def __init__(self, paths: list[str], sizes: list[int], n_tokens: int, n_kinds: int):
        self.paths, self.first = paths, np.append(0, np.cumsum(sizes)).astype(np.int64)
        self.n_tokens, self.n_kinds, self.open = n_tokens, n_kinds, {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def _file(self, part: int):
        if part not in self.open:
            file = read_arrays(self.paths[part])
            if not mapped(self.paths[part]):
                self.open.clear()
            self.open[part] = EliasFano.of(file, "words"), file["counts"]
        return self.open[part]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of ascending hashes, all of them known."""
        part = _part(hashes, len(self.paths))
        out = np.zeros(len(hashes), np.int64)
        for p in np.unique(part).tolist():
            low, high = np.searchsorted(part, [p, p + 1])
            out[low:high] = self._file(p)[0].find(hashes[low:high])[0] + self.first[p]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of ascending ids."""
        part = np.searchsorted(self.first, ids, side="right") - 1
        out = np.zeros(len(ids), np.int64)
        for p in np.unique(part).tolist():
            low, high = np.searchsorted(part, [p, p + 1])
            out[low:high] = self._file(p)[1][ids[low:high] - self.first[p]]
        return out


def _part(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def first_level(docs: DataFrame, folder: str) -> Vocabulary:
    """Words of all rows of (text, learned), with their counts in the learned ones."""
    n = partitions(docs.sparkSession)

    def deal(batches):
        for batch in batches:
            learned = batch.column("learned").to_numpy(zero_copy_only=False)
            for first, part in blocks(batch.column("text"), BLOCK):
                token, count = tokens(part)
                known, which = np.unique(np.append(token, START), return_inverse=True)
                times = np.bincount(which, np.append(np.repeat(learned[first:first + len(part)], count), False), len(known)).astype(np.int64)
                cut = np.searchsorted(_part(known, n), np.arange(n + 1))
                hit = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_pydict({"part": pa.array(hit, pa.int32()), "x": [known[cut[p]:cut[p + 1]].tobytes() for p in hit],
                                                  "y": [_pack(times[cut[p]:cut[p + 1]]) for p in hit]})

    def merge(batches):
        for p, rows in _by_key(batches, "part"):
            known, which = np.unique(np.concatenate([np.frombuffer(r["x"], U64) for r in rows]), return_inverse=True)
            count = np.bincount(which, np.concatenate([_unpack(r["y"]) for r in rows]), len(known)).astype(U64)
            path = f"{folder}/words-{p}-{uuid.uuid4().hex}"
            write_arrays(path, {"counts": count if count.max() >> U64(32) else count.astype(np.uint32)} | EliasFano.build(known).arrays("words"))
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "path": [path], "size": [len(known)],
                                              "n": [int(count.sum())], "kinds": [int((count > 0).sum())]})

    dealt = docs.select("text", "learned").mapInArrow(deal, "part int, x binary, y binary")
    files = store(dealt.repartition(n, "part").sortWithinPartitions("part").mapInArrow(merge, "part int, path string, size long, n long, kinds long"), "ngram-words")
    rows = {r["part"]: r for r in files.collect()}  # one row per file, of which there are as many as shuffle partitions
    empty = {"path": "", "size": 0, "n": 0, "kinds": 0}
    rows = [rows.get(p, empty) for p in range(n)]
    return Vocabulary([r["path"] for r in rows], [r["size"] for r in rows], sum(r["n"] for r in rows), sum(r["kinds"] for r in rows))


# ---- counting ----

def range_bounds(docs: DataFrame, words_: Vocabulary) -> np.ndarray:
    """Bounds (b, a, c) of the shards' ranges, from about ``SAMPLED`` trigrams per shard."""
    n_docs, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    size = size or 0
    n = max(partitions(docs.sparkSession), size // SHARD_BYTES + 1)
    every_doc = max(1, n_docs // (50 * n + 1000))
    every = max(1, (size // 6 + n_docs) // every_doc // (SAMPLED * n))

    def sample(batches):
        for batch in batches:
            for _, part in blocks(batch.column(0), 1 << 20):
                found = Trigrams(*tokens(part))
                picked = np.flatnonzero(mix(np.arange(len(found.order), dtype=U64) + found.known[-1]) % U64(every) == 0)
                spot, ids = np.searchsorted(found.first, picked, "right") - 1, words_.ids(found.known)
                yield pa.RecordBatch.from_arrays([pa.array(ids[x[spot]]) for x in (found.b, found.a, found.c)], ["b", "a", "c"])

    picked = docs.filter(F.pmod(F.xxhash64("text", "id"), F.lit(every_doc)) == 0).select("text")
    found = np.array(picked.mapInArrow(sample, "b long, a long, c long").collect(), np.int64).reshape(-1, 3)
    found = np.unique(found, axis=0)
    return np.unique(found[np.arange(1, n) * len(found) // n], axis=0) if len(found) >= n > 1 else found[:0]


def _count(docs: DataFrame, words_: Vocabulary, bounds: np.ndarray, folder: str) -> DataFrame:
    """Counted trigrams of every shard, written to files; rows of ``COUNTED`` that name them and hold what bounds cut."""
    n = len(bounds) + 1

    def deal(batches):
        for batch in batches:
            learned = batch.column("learned").to_numpy(zero_copy_only=False)
            for first, part in blocks(batch.column("text"), BLOCK):
                found = Trigrams(*tokens(part))
                times, ids = found.sums(learned[first:first + len(part)][found.doc]), words_.ids(found.known)
                cut, out = found.cuts(ids, bounds), {"shard": [], "x": []}
                for s in range(n):
                    hit = np.flatnonzero(times[cut[s]:cut[s + 1]]) + cut[s]
                    if len(hit):
                        out["shard"].append(s)
                        out["x"].append(_packed(found, ids, hit, times[hit]))
                yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), pa.array(out["x"], pa.list_(pa.binary()))], ["shard", "x"])

    def merge(batches):
        for s, rows in _by_key(batches, "shard"):
            own = [_unpack_ids(r["x"][0]) for r in rows]
            used = np.unique(np.concatenate(own))
            places = [np.searchsorted(used, ids).astype(np.int32) for ids in own]
            b, a, c = (np.concatenate([place[_unpack(r["x"][j])] for r, place in zip(rows, places, strict=True)]) for j in (1, 2, 3))
            t = np.concatenate([_unpack(r["x"][4]).astype(np.int64) for r in rows])
            rows.clear()
            b, a, c, order, first = ordered(b, a, c, len(used))
            t = np.add.reduceat(t[order], first[:-1])
            path = f"{folder}/counts-{s}-{uuid.uuid4().hex}"
            packed = {"ids": _pack_ids(used)} | {k: _pack(x) for k, x in zip("bact", (b, a, c, t), strict=True)}
            write_arrays(path, {k: np.frombuffer(x, np.uint8) for k, x in packed.items()})
            yield _rows({"kind": 0, "shard": s, "path": path, "n": len(t)})

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield _rows(r)
                yield from _cut(r["shard"], *read_counts(r["path"]), bounds)

    dealt = docs.select("text", "learned").mapInArrow(deal, "shard int, x array<binary>")
    files = _written(dealt.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(merge, COUNTED), f"{folder}/files")
    # a shard that counted nothing answers too: it may lie inside a word's or context's range
    every = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("shard"))
    return _written(every.join(files, "shard", "left").select(F.lit(0).alias("kind"), *files.columns[1:]).repartition(n, "shard").mapInArrow(ask, COUNTED), f"{folder}/asked")


def _packed(found: Trigrams, ids: np.ndarray, hit, times: np.ndarray) -> list[bytes]:
    """The trigrams ``hit``: their words' ids, places among these, and times."""
    used, local = np.unique(np.concatenate([found.b[hit], found.a[hit], found.c[hit]]), return_inverse=True)
    return [_pack_ids(ids[used]), *map(_pack, np.split(local, 3)), _pack(times)]


def read_counts(path: str | None) -> tuple[np.ndarray, ...]:
    """Ids b, a, c and times of a shard's counted trigrams."""
    if path is None:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    file = {k: x.tobytes() for k, x in read_arrays(path).items()}
    ids = _unpack_ids(file["ids"])
    return (*(ids[_unpack(file[k])] for k in "bac"), _unpack(file["t"]).astype(np.int64))


def _written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a stored table of the model's folder, which goes with it."""
    with scoped_conf(df.sparkSession, CLEAN_UP):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rows(*rows) -> pa.RecordBatch:
    names = ("kind", "shard", "k1", "k2", "n", "t", "path", "x", "y")
    kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_pydict({k: [r.get(k) for r in rows] for k in names}, pa.schema(list(zip(names, kinds, strict=True))))


def _cut(s: int, b, a, c, t, bounds):
    """What a shard holds of the words' successors (kind 2) and contexts' counts (kind 3) that its bounds cut."""
    ends, out = bounds[max(0, s - 1):s + 1], []
    for word in np.unique(ends[:, 0]).tolist():
        low, high = np.searchsorted(b, [word, word + 1])
        after, place = np.unique(c[low:high], return_inverse=True)
        out.append({"kind": 2, "shard": s, "k1": word, "x": after.tobytes(), "y": np.bincount(place, t[low:high], len(after)).astype(np.int64).tobytes()})
    for word, before in np.unique(ends[:, :2], axis=0).tolist():
        hit = (b == word) & (a == before)
        out.append({"kind": 3, "shard": s, "k1": word, "k2": before, "n": int(t[hit].sum()), "t": int(hit.sum())})
    if out:
        yield _rows(*out)


def _whole(counted: DataFrame) -> DataFrame:
    """Answers to each shard: all successors (kind 2) and whole counts (kind 3) of what its bounds cut."""

    def merge(batches):
        for word, rows in _by_key(batches, "k1"):  # the lists of one word: the vocabulary at most in each
            c, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for r in rows:
                c, which = np.unique(np.concatenate([c, np.frombuffer(r["x"], np.int64)]), return_inverse=True)
                n = np.bincount(which, np.concatenate([n, np.frombuffer(r["y"], np.int64)]), len(c)).astype(np.int64)
            for r in rows:
                yield _rows({"kind": 2, "shard": r["shard"], "k1": word, "x": c.tobytes(), "y": n.tobytes()})

    two, three = counted.filter("kind = 2"), counted.filter("kind = 3")
    after = two.repartition(partitions(counted.sparkSession), "k1").sortWithinPartitions("k1", "shard").mapInArrow(merge, COUNTED)
    sums = three.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    return after.unionByName(three.select("kind", "shard", "k1", "k2").join(sums, ["k1", "k2"]), allowMissingColumns=True)


# ---- the trie ----

def build_trie(b, a, c, t, n_words: int, after: dict, whole: dict) -> dict[str, np.ndarray]:
    """The upper levels of one shard from its trigrams (ids b, a, c in order of (b, a, c); t: times).

    ``after``: word -> (successors, times) and ``whole``: (word, word before) -> (n, t), where a bound cuts them.
    """
    heads = np.unique(np.concatenate([b, np.array([*after, *(w for w, _ in whole)], np.int64)]))
    b = np.searchsorted(heads, b)
    # successors of words
    own = b * n_words + c
    pair, which = np.unique(own, return_inverse=True)
    times = np.bincount(which, t, len(pair))
    cut = np.searchsorted(heads, np.array(list(after), np.int64))
    keep = ~np.isin(pair // n_words, cut)
    pair = np.concatenate([pair[keep], *(at * n_words + cs for at, (cs, _) in zip(cut, after.values(), strict=True))])
    times = np.concatenate([times[keep], *(ns for _, ns in after.values())])
    order = np.argsort(pair)
    pair, times = pair[order], times[order]
    head = pair // n_words
    total, kinds = np.bincount(head, times, len(heads)), np.bincount(head, minlength=len(heads))
    rank = np.searchsorted(pair, own) - np.searchsorted(head, np.arange(len(heads)))[b]
    # contexts (a, b)
    own = b * n_words + a
    given = np.array([int(np.searchsorted(heads, w)) * n_words + before for w, before in whole], np.int64)
    context = np.unique(np.concatenate([own, given[np.array([n > 0 for n, _ in whole.values()], bool)]]))
    node = np.searchsorted(context, own)
    tokens_, different = np.bincount(node, t, len(context)), np.bincount(node, minlength=len(context))
    for key, (n, k) in zip(given.tolist(), whole.values(), strict=True):
        if n > 0:
            at = np.searchsorted(context, key)
            tokens_[at], different[at] = n, k
    out = {"A2": codes(times / (total + kinds)[head]),
           "L2": codes(np.where(total > 0, kinds, 1) / np.where(total > 0, total + kinds, 1)),
           "A3": codes(t / (tokens_ + different)[node]),
           "L3": codes(different / (tokens_ + different))}
    return out | EliasFano.build(heads).arrays("heads") | ChildLists.build(head, pair % n_words, len(heads)).arrays("after") \
        | ChildLists.build(context // n_words, context % n_words, len(heads)).arrays("before") | ChildLists.build(node, rank, len(context)).arrays("third")


class Trie:
    """One shard's upper levels, as views of its file."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.heads = EliasFano.of(arrays, "heads")
        self.after, self.before, self.third = (ChildLists.of(arrays, k) for k in ("after", "before", "third"))
        self.A2, self.L2, self.A3, self.L3 = (arrays[k] for k in ("A2", "L2", "A3", "L3"))

    def probabilities(self, b: np.ndarray, a: np.ndarray, c: np.ndarray, base: np.ndarray) -> np.ndarray:
        """p(c | a b) of trigrams in runs of equal (b, a); ``base``: p1(c)."""
        fresh = np.ones(len(b), bool)
        fresh[1:] = b[1:] != b[:-1]
        at, there = self.heads.find(b[fresh].astype(U64))
        head = np.where(there, at, -1)[np.cumsum(fresh) - 1]
        p, rank = base.copy(), np.full(len(c), -1, np.int64)
        # p(c | b), by the successors of b
        hit = np.flatnonzero(head >= 0)
        p[hit] *= VALUES[self.L2[head[hit]]]
        found, low = self.after.find(head[hit], c[hit])
        ok = found >= 0
        p[hit[ok]] += VALUES[self.A2[found[ok]]]
        rank[hit[ok]] = (found - low)[ok]
        # p(c | a b), by the rank of c among them
        fresh[1:] |= a[1:] != a[:-1]
        node = np.full(int(fresh.sum()), -1, np.int64)
        both = np.flatnonzero(head[fresh] >= 0)
        node[both] = self.before.find(head[fresh][both], a[fresh][both])[0]
        node = node[np.cumsum(fresh) - 1]
        hit = np.flatnonzero(node >= 0)
        p[hit] *= VALUES[self.L3[node[hit]]]
        hit = hit[rank[hit] >= 0]
        found, _ = self.third.find(node[hit], rank[hit])
        p[hit[found >= 0]] += VALUES[self.A3[found[found >= 0]]]
        return p


class Model:
    """The first level, shard files of the upper ones (a table of shard, path), and the bounds of their ranges."""

    def __init__(self, words_: Vocabulary, shards: DataFrame, bounds: np.ndarray):
        self.words, self.shards, self.bounds = words_, shards, bounds


def learn(docs: DataFrame) -> Model:
    """A model of the rows of (id, text, learned) that are ``learned``; its first level knows the other rows' words too, so it scores exactly these rows."""
    spark = docs.sparkSession
    folder = scratch(spark, "ngram-trie")
    place, name = file_system(folder)
    place.create_dir(f"{name}/counts")
    words_ = first_level(docs, folder)
    bounds = range_bounds(docs, words_)
    counted = _count(docs, words_, bounds, f"{folder}/counts")
    n_words = int(words_.first[-1])

    def build(batches):
        for s, rows in _by_key(batches, "shard"):
            of = lambda kind: [r for r in rows if r["kind"] == kind]  # noqa: B023, E731
            after = {r["k1"]: (np.frombuffer(r["x"], np.int64), np.frombuffer(r["y"], np.int64)) for r in of(2)}
            whole = {(r["k1"], r["k2"]): (r["n"], r["t"]) for r in of(3)}
            levels = build_trie(*read_counts(of(0)[0]["path"]), n_words, after, whole)
            path = f"{folder}/trie-{s}-{uuid.uuid4().hex}"
            size = write_arrays(path, levels)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "path": [path], "bytes": [size], "trigrams": [len(levels["A3"])]})

    parts = counted.filter("kind = 0").unionByName(_whole(counted), allowMissingColumns=True)
    shards = store(parts.repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard")
                   .mapInArrow(build, "shard int, path string, bytes long, trigrams long"), "ngram-shards")
    place.delete_dir(f"{name}/counts")  # the shards hold all of it
    return Model(words_, shards, bounds)


# ---- scoring ----

SENT = "shard int, block long, path string, ids array<long>, n array<long>, x array<binary>"
SUMS = "block long, shard int, ids array<long>, n array<long>, doc binary, known binary, base binary, score binary"
AT_ONCE = 65_536  # trigrams that are looked up together


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score), a row per row of (id, text)."""
    bounds, n, words_ = model.bounds, len(model.bounds) + 1, model.words

    def deal(batches):
        for batch in batches:
            at = batch.column("at")
            for first, part in blocks(batch.column("text"), BLOCK):
                token, count = tokens(part)
                found = Trigrams(token, count)
                block = at[first].as_py()
                out = {"shard": [block % n], "ids": [batch.column("id").slice(first, len(part)).to_pylist()], "n": [count.tolist()], "x": [None]}
                upto, times, ids = found.first, np.diff(found.first), words_.ids(found.known)
                doc, cut = found.doc[found.order], found.cuts(ids, bounds)
                for s in np.flatnonzero(np.diff(cut)).tolist():
                    span = slice(cut[s], cut[s + 1])
                    out["shard"].append(s)
                    out["ids"].append(None)
                    out["n"].append(None)
                    out["x"].append([*_packed(found, ids, span, times[span]), _pack(doc[upto[cut[s]]:upto[cut[s + 1]]])])
                rows = len(out["shard"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(out["shard"], pa.int32()), pa.array([block] * rows, pa.int64()), pa.nulls(rows, pa.string()),
                    pa.array(out["ids"], pa.list_(pa.int64())), pa.array(out["n"], pa.list_(pa.int64())), pa.array(out["x"], pa.list_(pa.binary()))],
                    ["shard", "block", "path", "ids", "n", "x"])

    def look_up(batches):
        shard, trie, held, size = None, None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["shard"] != shard or size > AT_ONCE):
                    yield _sums(words_, trie, held)
                    held, size = [], 0
                shard = r["shard"]
                if r["path"] is not None:
                    trie = Trie(read_arrays(r["path"]))
                elif r["x"] is None:
                    yield _sum_rows([{"block": r["block"], "shard": -1, "ids": r["ids"], "n": r["n"]}])
                else:
                    held.append(r)
                    size += len(r["x"][5])
        if held:
            yield _sums(words_, trie, held)

    def add_up(batches):
        for block, rows in _by_key(batches, "block"):
            ids, count = rows[0]["ids"], rows[0]["n"]
            known, base, total = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
            for r in rows[1:]:
                doc = _unpack(r["doc"])
                known[doc] += _unpack(r["known"]).astype(np.int64)
                base[doc] += np.frombuffer(r["base"], np.float64)
                total[doc] += np.frombuffer(r["score"], np.float64)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n_tokens": pa.array(count, pa.int64()),
                                              "n_known": known, "base_score": base, "score": total})

    sent = docs.select("id", "text").withColumn("at", F.monotonically_increasing_id()).mapInArrow(deal, SENT)
    files = model.shards.select("shard", F.lit(-1).cast("long").alias("block"), "path")
    met = sent.unionByName(files, allowMissingColumns=True).repartition(n, "shard").sortWithinPartitions("shard", "block")
    sums = met.mapInArrow(look_up, SUMS).repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "shard")
    return sums.mapInArrow(add_up, "id long, n_tokens long, n_known long, base_score double, score double")


def _sum_rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "shard": pa.int32(), "ids": pa.list_(pa.int64()), "n": pa.list_(pa.int64()),
             "doc": pa.binary(), "known": pa.binary(), "base": pa.binary(), "score": pa.binary()}
    return pa.RecordBatch.from_pydict({k: [r.get(k) for r in rows] for k in kinds}, pa.schema(list(kinds.items())))


def _sums(words_: Vocabulary, trie: Trie, rows: list[dict]) -> pa.RecordBatch:
    """Sums per document of each packed row."""
    own = [_unpack_ids(r["x"][0]) for r in rows]
    used = np.unique(np.concatenate(own))
    places = [np.searchsorted(used, ids) for ids in own]
    b, a, c = (np.concatenate([place[_unpack(r["x"][j])] for r, place in zip(rows, places, strict=True)]) for j in (1, 2, 3))
    count = words_.counts(used)
    base = (count + 1) / (words_.n_tokens + words_.n_kinds + 1)
    score_ = np.log10(trie.probabilities(used[b], used[a], used[c], base[c]))
    count, base = count[c], np.log10(base)[c]
    out, at = [], 0
    for r in rows:
        times, doc = _unpack(r["x"][4]).astype(np.int64), _unpack(r["x"][5])
        spot = np.repeat(np.arange(at, at + len(times)), times)
        at += len(times)
        docs = np.flatnonzero(np.bincount(doc))
        sums = [np.bincount(doc, x[spot])[docs] for x in (count > 0, base, score_)]
        out.append({"block": r["block"], "shard": r["shard"], "doc": _pack(docs), "known": _pack(sums[0].astype(np.int64)),
                    "base": sums[1].tobytes(), "score": sums[2].tobytes()})
    return _sum_rows(out)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); rows that aren't held out are learned.

    ``docs`` is read four times and must give the same rows each time, as a stored table does.
    """
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    read = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), (~held).alias("learned"))
    model = learn(read)
    own = score(read, model)
    return own.withColumn("train_tokens", F.lit(model.words.n_tokens).cast("long"))


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = score_documents(table(spark, sf_dir, "documents"), held_out=rule(F.col("doc_id")))
    return scored.select(F.col("id").alias("doc_id"), rule(F.col("id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op11_lm_score": op11_lm_score}
ORACLES: dict[str, str] = {}
