"""N-gram Jaccard self-join by PartEnum signatures (operator 10).

A document's set holds the distinct shingles of its words.  Equal sets are one
class, whose node is a 64-bit hash of the set.  Between classes:

* Sizes are cut into overlapping bands, so that any two sets that are similar
  enough fall into one band together.  In a band their symmetric difference is
  at most K elements.
* The feature domain is cut into n1 partitions of 3 parts.  With more than
  K / 2 partitions, some partition holds one differing element at most, so two
  of its three parts are equal.  A set's signatures are its content of every
  two parts of every partition; similar sets share one.
* Two empty parts are no signature, as unrelated sets would share them.  n1 has
  a few partitions to spare; a set with more such weak partitions than that
  also gets the signatures of another division of the domain, so that no pair
  is lost.
* Sets that share a signature are linked to the smallest of them first, each to
  one, then to the others that it met so.  Only signatures whose sets are still in
  different components are looked at after that: while they hold many pairs, one set of
  each component is compared with one other, a few times; then all their pairs that are apart.
  A parity bitmap, whose Hamming distance is a lower bound
  of the symmetric difference, discards those that can't be similar.
* Every pair that remains is verified exactly on both whole sets.

Pairs inside one component never need a look, so the components, and the
smallest doc_id of each, are exact.

Defined results: null, empty and blank texts have an empty set, no links and
are a component of their own; repeated rows are of one class; rows without
doc_id join classes but never name a component (null, if nothing else is in
it); an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, partitions, store, table, tidy
from .sketch import POSITIONS, build_filter, positions, slabs_for
from .spans import U64, blocks, mix
from .words import shingle_sets

GROWTH = 1.6   # a band's lowest size to the next one's
SPARE = 0.35   # spare partitions, as a share
SEEDS = 6      # divisions of the domain
PER_BUCKET = 1_000_000  # shingles per bucket of signatures, which one task holds
ROUNDS = 3       # of one set per component, before all pairs
FEW = 8          # pairs that are apart for each member of a group: no more rounds are needed before all pairs
BATCH = 1_000    # texts or packed signatures that a Python task gets at once
PER_GROUP = 200  # texts of one side of a group that is verified together


class Bands:
    """Size bands for Jaccard num / den: lowest and highest size, first size of the next band, K, n1, spare."""

    def __init__(self, num: int, den: int, largest: int):
        low, rows = 1, []
        while low <= largest:
            after = max(low + 1, int(np.ceil(low * GROWTH)))
            high = (after - 1) * den // num
            differ = (after - 1 + high) * (den - num) // (den + num)
            base = differ // 2 + 1
            spare = int(base * SPARE)
            rows.append((low, high, after, differ, base + spare, spare))
            low = after
        self.low, self.high, self.after, self.differ, self.n1, self.spare = (np.array(x, np.int64) for x in zip(*rows, strict=True))

    def instances(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in sizes, band) of every band that a size falls into and in which sets can differ."""
        top = np.searchsorted(self.low, sizes, side="right") - 1
        who, band = [], []
        for back in range(3):
            b = top - back
            ok = (sizes > 0) & (b >= 0)
            ok[ok] = (sizes[ok] <= self.high[b[ok]]) & (self.differ[b[ok]] > 0)
            who.append(np.flatnonzero(ok))
            band.append(b[ok])
        return np.concatenate(who), np.concatenate(band)


def set_hashes(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's set (0 for an empty one)."""
    size = np.diff(off)
    out = []
    for seed in (0x1234567, 0x89ABCDEF01):
        total = np.concatenate([[U64(0)], np.cumsum(mix(hashes + U64(seed)), dtype=U64)])
        out.append(np.where(size > 0, mix(total[off[1:]] - total[off[:-1]] + size.astype(U64)), U64(0)))
    return out[0], out[1]


def _spread(hashes, off, who):
    """Elements of the rows ``who``, and the place in ``who`` that each belongs to."""
    size = (off[1:] - off[:-1])[who]
    place = np.repeat(np.arange(len(who)), size)
    first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    return hashes[np.arange(int(size.sum())) - first[place] + off[who][place]], place


def signatures(hashes: np.ndarray, off: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit signature, row) of all signatures of all rows."""
    who, band = bands.instances(np.diff(off))
    sigs, rows = [], []
    for seed in range(SEEDS):
        if not len(who):
            break
        n1 = bands.n1[band]
        base = np.concatenate([[0], np.cumsum(n1)]).astype(np.int64)
        items, place = _spread(hashes, off, who)
        dealt = mix(items ^ U64((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        cell = 3 * (base[place] + ((dealt >> U64(32)) % n1[place].astype(U64)).astype(np.int64)) + ((dealt & U64(0xFFFF)) % U64(3)).astype(np.int64)
        value = mix(dealt + U64(0x632BE59BD9B4E019))
        n_cells = int(3 * base[-1])
        low = np.bincount(cell, (value & U64(0xFFFFFFFF)).astype(np.float64), n_cells).astype(U64)
        high = np.bincount(cell, (value >> U64(32)).astype(np.float64), n_cells).astype(U64)
        content = (low + (high << U64(32))).reshape(-1, 3)
        held = np.bincount(cell, minlength=n_cells).reshape(-1, 3)
        owner = np.repeat(np.arange(len(who)), n1)
        part = np.arange(len(owner)) - base[owner]
        empty = np.stack([held[:, 1] + held[:, 2], held[:, 0] + held[:, 2], held[:, 0] + held[:, 1]], axis=1) == 0
        weak = np.bincount(owner, empty.any(axis=1), len(who)) > bands.spare[band]
        give_all = weak & (seed == SEEDS - 1)
        tag = mix((band[owner].astype(U64) << U64(40)) + (part.astype(U64) << U64(8)) + U64(seed * 4))
        for skip in range(3):
            a, b = (x for x in range(3) if x != skip)
            sig = mix(content[:, a] * U64(0xD6E8FEB86659FD93) + content[:, b] * U64(0xA0761D6478BD642F) + tag + U64(skip))
            ok = ~empty[:, skip] | give_all[owner]
            sigs.append(sig[ok])
            rows.append(who[owner[ok]])
        who, band = who[weak], band[weak]
    return (np.concatenate(sigs), np.concatenate(rows)) if sigs else (np.zeros(0, U64), np.zeros(0, np.int64))


def parity_bitmaps(hashes: np.ndarray, off: np.ndarray) -> list[bytes]:
    """A bitmap of at least twice as many bits as the set has elements; each element flips one bit."""
    out = []
    for a, b in zip(off.tolist(), off[1:].tolist(), strict=False):
        bits = max(64, 1 << (2 * (b - a) - 1).bit_length()) if b > a else 64
        flips = np.bincount((hashes[a:b] & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(flips.astype(bool), bitorder="little").tobytes())
    return out


class Parities:
    """The parity bitmaps of some nodes, by width, for tests of many pairs at once."""

    def __init__(self, bits: list[bytes], sizes: np.ndarray, num: int, den: int):
        self.sizes, self.num, self.den = sizes, num, den
        self.width = np.array([len(b) for b in bits])
        self.place, self.rows = np.zeros(len(bits), np.int64), {}
        for w in np.unique(self.width):
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            self.rows[int(w)] = np.frombuffer(b"".join([bits[i] for i in own]), U64).reshape(len(own), -1)

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether neither size nor parity rules the pairs (a, b) out."""
        x, y = self.sizes[a], self.sizes[b]
        ok = np.minimum(x, y) * self.den >= self.num * np.maximum(x, y)
        at = np.flatnonzero(ok)
        most = (x[at] + y[at]) * (self.den - self.num) // (self.den + self.num)
        wa, wb = self.width[a[at]], self.width[b[at]]
        for w, v in {(int(p), int(q)) for p, q in zip(*np.unique(np.stack([wa, wb]), axis=1), strict=True)}:
            pick = np.flatnonzero((wa == w) & (wb == v))
            step = max(1, (1 << 22) // max(w, v))
            for cut in range(0, len(pick), step):
                some = pick[cut:cut + step]
                one, two = self.rows[w][self.place[a[at[some]]]], self.rows[v][self.place[b[at[some]]]]
                while one.shape[1] > two.shape[1]:  # a wider bitmap folds onto a narrower one
                    one = one[:, :one.shape[1] // 2] ^ one[:, one.shape[1] // 2:]
                while two.shape[1] > one.shape[1]:
                    two = two[:, :two.shape[1] // 2] ^ two[:, two.shape[1] // 2:]
                ok[at[some]] = np.bitwise_count(one ^ two).sum(axis=1) <= most[some]
        return ok


def _profile(docs: DataFrame, key: str, text: str) -> DataFrame:
    @tidy
    def scan(batches):
        for batch in batches:
            for at, part in blocks(batch.column(1)):
                hashes, off = shingle_sets(part)
                node, check = set_hashes(hashes, off)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(part)), pa.array(np.diff(off)), pa.array(node.view(np.int64)),
                    pa.array(check.view(np.int64)), pa.array(parity_bitmaps(hashes, off), pa.binary()), batch.column(2).slice(at, len(part))],
                    ["id", "n", "node", "check", "parity", "mark"])

    return store(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
                 .select("id", "text", F.when(F.col("id").isNull(), F.xxhash64("text")).alias("mark"))  # names a text without id
                 .mapInArrow(scan, "id long, n long, node long, check long, parity binary, mark long"), "shingle-profile", BATCH)


def _shared(docs: DataFrame, text: str, bands: Bands, n_buckets: int) -> DataFrame:
    """Sets that share signatures, stored: rows (grp, centre, node, times).

    ``group`` null: a star edge, from ``centre`` to ``node``, with the number of signatures it was
    found by.  Else a member of a signature's group of three or more sets.
    """

    @tidy
    def sign(batches):
        for batch in batches:
            for _, part in blocks(batch.column(0)):
                hashes, off = shingle_sets(part)
                node, _ = set_hashes(hashes, off)
                # a set that the block holds twice is signed once
                node, pick = np.unique(node, return_index=True)
                items, place = _spread(hashes, off, pick)
                yield _packed(node, *signatures(items, np.searchsorted(place, np.arange(len(pick) + 1)), bands), n_buckets)

    @tidy
    def meet(batches):
        held: dict[int, list] = {}
        last = None
        for batch in batches:
            for r in batch.to_pylist():
                if last is not None and r["bucket"] != last:
                    yield from _meet(last, held.pop(last))
                last = r["bucket"]
                held.setdefault(last, []).append(r)
        if last is not None:
            yield from _meet(last, held.pop(last))

    signed = docs.select(text).mapInArrow(sign, "bucket int, nodes binary, times binary, sigs binary")
    return store(signed.repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
                 .mapInArrow(meet, "grp long, centre long, node long, times long"), "shared-signatures", BATCH)


def _packed(node: np.ndarray, sig: np.ndarray, row: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """A row per bucket of a block's signatures: 64-bit nodes, each with the number (a byte) of 32-bit signatures that are its own."""
    bucket = ((sig >> U64(32)) % U64(n_buckets)).astype(np.int64)
    order = np.lexsort((row, bucket))
    sig, row, bucket = (sig & U64(0xFFFFFFFF)).astype(np.uint32)[order], row[order], bucket[order]
    at = np.arange(len(row))
    run = np.ones(len(row), bool)
    run[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
    run |= (at - np.maximum.accumulate(np.where(run, at, 0))) % 255 == 0  # a node with more is named again
    first = np.flatnonzero(run)
    nodes, times, dealt = node[row[first]], np.diff(np.append(first, len(row))).astype(np.uint8), bucket[first]
    held = np.unique(dealt)
    a, b = np.searchsorted(dealt, held), np.searchsorted(dealt, held, side="right")
    c, d = np.searchsorted(bucket, held), np.searchsorted(bucket, held, side="right")
    cut = lambda x, lo, hi: pa.array([x[i:j].tobytes() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), cut(nodes, a, b), cut(times, a, b), cut(sig, c, d)], ["bucket", "nodes", "times", "sigs"])


def _meet(bucket: int, rows: list):
    """Star edges and larger groups of one bucket's signatures."""
    node = np.concatenate([np.frombuffer(r["nodes"], np.int64) for r in rows])
    times = np.concatenate([np.frombuffer(r["times"], np.uint8) for r in rows])
    sig = np.concatenate([np.frombuffer(r["sigs"], np.uint32) for r in rows])
    rows.clear()
    known, which = np.unique(node, return_inverse=True)
    who = np.repeat(which, times)
    key = np.unique((sig.astype(U64) << U64(32)) | who.astype(U64))  # sets are ranked by node in a signature
    del sig, who
    sig, who = (key >> U64(32)).astype(np.int64), (key & U64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(sig)))
    begin, count = begin[count > 1], count[count > 1]
    if not len(begin):
        return
    group = np.repeat(np.arange(len(begin)), count)
    at = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    member, centre = who[at], np.repeat(who[begin], count)
    pair = np.repeat(count == 2, count)
    edge, found = np.unique((centre.astype(U64) << U64(32) | member.astype(U64))[member != centre], return_counts=True)
    from_, to = (edge >> U64(32)).astype(np.int64), (edge & U64(0xFFFFFFFF)).astype(np.int64)
    # a member of larger groups needs one centre of them here; a group of two is its star edge alone
    keep = np.bincount(np.searchsorted(edge, (centre.astype(U64) << U64(32) | member.astype(U64))[pair & (member != centre)]), minlength=len(edge)) > 0
    order = np.lexsort((from_, -found, to))
    keep[order[np.concatenate([[True], to[order][1:] != to[order][:-1]])]] = True
    yield _table(None, known[from_[keep]], known[to[keep]], found[keep])
    # one group of each list of members
    print_of = np.add.reduceat(mix(known[member].view(U64) + U64(77)), np.cumsum(count) - count)
    _, one = np.unique(print_of, return_index=True)
    one = one[count[one] > 2]
    if len(one):
        large = np.isin(group, one)
        name = (mix(group[large].astype(U64) + (U64(bucket) << U64(32)))).view(np.int64)
        yield _table(name, np.zeros(len(name), np.int64), known[member[large]], np.ones(len(name), np.int64))


def _table(group, centre, node, times) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.nulls(len(node), pa.int64()) if group is None else pa.array(group), pa.array(centre), pa.array(node),
        pa.array(times.astype(np.int64))], ["grp", "centre", "node", "times"])


def _verify(docs: DataFrame, key: str, text: str, pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes; g, i, j: the group where they meet) whose whole sets are similar enough, stored.

    Texts of the classes' first documents travel, not sets, and each once to
    every group that has a pair of it.  Groups are bounded by their makers.
    A class without any id (``rep`` null) is read from a text of the hash ``mark``.
    """
    n = pairs.count()
    if not n:
        return pairs.select("a", "b")
    n_slabs = slabs_for(2 * n)
    dest = ["g", "i", "j"]
    ways = store(pairs.select(*dest, F.col("a").alias("node")).unionByName(pairs.select(*dest, F.col("b").alias("node"))).distinct()
                 .join(reps.select("node", F.coalesce("rep", "mark").alias("rep"), F.col("rep").isNull().alias("unnamed")), "node"), "ways")

    def insert(batches):
        for batch in batches:
            yield positions(mix(batch.column(0).to_numpy().view(U64)), n_slabs)

    wanted = docs.sparkSession.sparkContext.broadcast(build_filter(ways.select("rep").distinct().mapInArrow(insert, POSITIONS), n_slabs, 1))

    @tidy
    def scan(batches):
        for batch in batches:
            hit = np.flatnonzero(wanted.value.test(mix(batch.column(0).to_numpy().view(U64))))
            batch = batch.take(pa.array(hit))
            for at, part in blocks(batch.column(1)):
                node, _ = set_hashes(*shingle_sets(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(node.view(np.int64)),
                                                  batch.column(1).slice(at, len(part))], ["rep", "node", "text"])

    read = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text"))
    found = read.filter("rep is not null").mapInArrow(scan, "rep long, node long, text string").withColumn("unnamed", F.lit(False))
    # a text that many rows without id hold travels once
    unnamed = read.filter("rep is null").select(F.xxhash64("text").alias("rep"), "text").mapInArrow(scan, "rep long, node long, text string") \
        .dropDuplicates(["rep", "node"]).withColumn("unnamed", F.lit(True))
    texts = found.unionByName(unnamed).join(ways, ["rep", "node", "unnamed"]) \
        .select(*dest, F.lit(0).alias("side"), F.col("node").alias("a"), F.col("node").alias("b"), "text")
    asked = pairs.select(*dest, F.lit(1).alias("side"), "a", "b", F.lit(None).cast("string").alias("text"))

    @tidy
    def compare(batches):
        group, sets = None, {}
        for batch in batches:
            side = batch.column("side").to_numpy()
            where = list(zip(*(batch.column(c).to_pylist() for c in dest), strict=True))
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            hashes, off = {}, {}
            for at, part in blocks(batch.column("text")):
                made = shingle_sets(part)
                for r in range(len(part)):
                    hashes[at + r], off[at + r] = made[0], made[1][r:r + 2]
            good = ([], [])
            for r, place in enumerate(where):
                if place != group:
                    group, sets = place, {}
                if side[r] == 0:
                    sets[a[r]] = hashes[r][off[r][0]:off[r][1]].copy()
                elif a[r] in sets and b[r] in sets:
                    x, y = sets[a[r]], sets[b[r]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both * den >= num * (len(x) + len(y) - both):
                        good[0].append(a[r])
                        good[1].append(b[r])
            if good[0]:
                yield pa.RecordBatch.from_arrays([pa.array(good[0], pa.int64()), pa.array(good[1], pa.int64())], ["a", "b"])

    met = texts.unionByName(asked).repartition(*dest).sortWithinPartitions(*dest, "side")  # no number: few pairs need few tasks
    return store(met.mapInArrow(compare, "a long, b long"), "similar-pairs", BATCH)


def _plausible(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, times) that neither size nor parity rules out, stored."""
    side = lambda c: reps.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))

    def test(batches):
        for batch in batches:
            size = np.concatenate([batch.column("na").to_numpy(), batch.column("nb").to_numpy()])
            bits = batch.column("pa").to_pylist() + batch.column("pb").to_pylist()
            n = len(batch)
            ok = Parities(bits, size, num, den).possible(np.arange(n), np.arange(n, 2 * n)) if n else np.zeros(0, bool)
            yield batch.select(["a", "b", "times"]).filter(pa.array(ok))

    return store(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(test, "a long, b long, times long"), "plausible-stars")


def _at_hubs(pairs: DataFrame) -> DataFrame:
    """Pairs with the group where they meet: that of the node with more pairs, in blocks of PER_GROUP others."""
    degree = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    side = lambda c: degree.select(F.col("a").alias(c), F.col("n").alias(f"n{c}"))
    first = F.struct(-F.col("na"), "a") < F.struct(-F.col("nb"), "b")
    hub = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("first", first)
    blocks = F.ceil(F.greatest("na", "nb") / PER_GROUP)
    return store(hub.select("a", "b", F.when(F.col("first"), F.col("a")).otherwise(F.col("b")).alias("g"),
                            F.pmod(F.xxhash64(F.when(F.col("first"), F.col("b")).otherwise(F.col("a"))), blocks).cast("int").alias("i"), F.lit(0).alias("j")),
                 "pairs-at-hubs")


def _in_blocks(pairs: DataFrame) -> DataFrame:
    """Pairs with the group where they meet: their connected family, cut into blocks of PER_GROUP nodes."""
    family = components(pairs)
    size = family.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / PER_GROUP).cast("int").alias("k"))
    named = family.join(size, "component").select("node", "component", F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("block"))
    one = named.select(F.col("node").alias("a"), F.col("component").alias("g"), F.col("block").alias("x"))
    two = named.select(F.col("node").alias("b"), F.col("block").alias("y"))
    return store(pairs.join(one, "a").join(two, "b").select("a", "b", "g", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")), "pairs-in-blocks")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id), a row per document, for links at Jaccard >= num / den."""
    spark = docs.sparkSession
    profile = _profile(docs, key, text)
    reps = store(profile.filter("n > 0").groupBy("node", "check").agg(F.min("id").alias("rep"), F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("parity").alias("parity")), "shingle-classes")
    shape = profile.agg(F.max("n"), F.sum(F.col("n").cast("double"))).first()
    largest, total = int(shape[0] or 0), shape[1] or 0.0
    slim = reps.select("node", "rep", "mark")
    if largest > 0:
        bands = Bands(num, den, largest)
        shared = _shared(docs, text, bands, max(partitions(spark), int(total / PER_BUCKET) + 1))
        stars = _plausible(shared.filter("grp is null").groupBy(F.col("centre").alias("a"), F.col("node").alias("b"))
                           .agg(F.sum("times").alias("times")), reps, num, den)
        best = stars.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a"))
        best = store(best.join(best.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_GROUP).cast("int").alias("k")), "a")
                     .select("a", "b", F.col("a").alias("g"), F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("i"), F.lit(0).alias("j")), "best-stars")
        good = _verify(docs, key, text, best, slim, num, den)
        comp = components(good)

        def further(found: DataFrame, comp: DataFrame, dealt) -> DataFrame:
            apart = store(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs-apart")
            return comp if apart.isEmpty() else _joined(comp, _verify(docs, key, text, dealt(apart), slim, num, den))

        # what is still apart: first the other star edges, a few per set; then inside the larger groups that are not of
        # one component yet, one set of each component against one other while there are many pairs; last all pairs
        comp = further(_apart(stars.join(best, ["a", "b"], "left_anti").select("a", "b"), comp), comp, _at_hubs)
        groups = shared.filter("grp is not null").select("grp", "node")
        for k in range(ROUNDS + 1):
            split = store(_split(groups, comp), "split-groups")
            members, pairs = split.agg(F.sum("n"), F.sum("apart")).first()
            if not members:
                break
            groups = store(groups.join(split.select("grp"), "grp", "left_semi"), "open-groups")
            if k == ROUNDS or pairs <= FEW * members:
                comp = further(_cross(groups, comp, reps, num, den), comp, _in_blocks)
                break
            comp = further(_plausible(_one_each(groups, comp, k), reps, num, den), comp, _at_hubs)
    else:
        comp = spark.createDataFrame([], "node long, component long")
    named = reps.select("node", "check", "rep").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "component").select("node", "check", "component_id")
    return profile.select("id", "n", "node", "check").join(named, ["node", "check"], "left") \
        .select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Those pairs whose nodes are in different components so far."""
    side = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left") \
        .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _joined(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """The components after further edges: only those of components, a node each, are walked."""
    if edges.isEmpty():
        return comp
    side = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    between = edges.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    found = components(between)
    moved = comp.join(found.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left") \
        .select("node", F.coalesce("to", "component").alias("component"))
    return store(moved.unionByName(found.join(comp.select("node"), "node", "left_anti")), "components")


def _split(members: DataFrame, comp: DataFrame) -> DataFrame:
    """The groups that hold sets of different components: (grp, n, apart), their sets and the pairs of different components."""
    labelled = members.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    each = labelled.groupBy("grp", "component").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return each.groupBy("grp").agg(F.sum("n").alias("n"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("apart")).filter("apart > 0")


def _one_each(members: DataFrame, comp: DataFrame, k: int) -> DataFrame:
    """Inside each group one set of every component (another one each round ``k``) with that of one component: linear in the members."""
    labelled = members.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    one = labelled.groupBy("grp", "component").agg(F.min_by("node", F.xxhash64("node", F.lit(k))).alias("b"))
    centre = one.groupBy("grp").agg(F.min_by("b", F.xxhash64("component", F.lit(k))).alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return one.join(centre, "grp").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("times", F.lit(1).cast("long"))


def _cross(members: DataFrame, comp: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components inside a group, less those that size or parity rules out."""
    labelled = members.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = labelled.join(reps.select("node", "n", "parity"), "node") \
        .select("grp", "node", "component", "n", "parity")

    @tidy
    def pairs(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= 60_000:
                rows = pa.Table.from_batches(held).combine_chunks()
                group = rows.column("grp").to_numpy()
                last = int(np.flatnonzero(group != group[-1])[-1]) + 1 if group[0] != group[-1] else 0  # a group is kept whole
                if last:
                    yield from _pairs(rows.slice(0, last), num, den)
                held = rows.slice(last).to_batches()
                n = sum(map(len, held))
        if n:
            yield from _pairs(pa.Table.from_batches(held).combine_chunks(), num, den)

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(pairs, "a long, b long")


def _pairs(rows: pa.Table, num: int, den: int):
    """Pairs of different components inside the groups of ``rows`` (in order of group), each once."""
    nodes, component = rows.column("node").to_numpy(), rows.column("component").to_numpy()
    known, first, which = np.unique(nodes, return_index=True, return_inverse=True)
    bits = rows.column("parity").take(pa.array(first)).to_pylist()
    test = Parities(bits, rows.column("n").to_numpy()[first], num, den)
    component = component[first]
    group = rows.column("grp").to_numpy()
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.append(begin, len(group)))
    for m in np.unique(count).tolist():
        starts = begin[count == m]
        if m <= 512:
            i, j = np.triu_indices(m, 1)
            step = max(1, 2_000_000 // max(1, len(i)))
            for cut in range(0, len(starts), step):
                members = which[starts[cut:cut + step, None] + np.arange(m)]
                yield from _possible(members[:, i].ravel(), members[:, j].ravel(), known, component, test)
        else:  # one member against the rest at a time
            for start in starts.tolist():
                members = which[start:start + m]
                for k in range(m - 1):
                    yield from _possible(np.full(m - 1 - k, members[k]), members[k + 1:], known, component, test)


def _possible(a: np.ndarray, b: np.ndarray, known: np.ndarray, component: np.ndarray, test: Parities):
    apart = component[a] != component[b]
    a, b = a[apart], b[apart]
    pair = np.unique(np.minimum(a, b).astype(U64) << U64(32) | np.maximum(a, b).astype(U64))
    a, b = (pair >> U64(32)).astype(np.int64), (pair & U64(0xFFFFFFFF)).astype(np.int64)
    ok = test.possible(a, b)
    if ok.any():
        yield pa.RecordBatch.from_arrays([pa.array(known[a[ok]]), pa.array(known[b[ok]])], ["a", "b"])


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


QUERIES = {"op10_ngram_join": op10_ngram_join}
ORACLES = {"op10_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM inter JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT documents.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles,
       CAST(least(documents.doc_id, coalesce(min(reach.b), documents.doc_id)) AS BIGINT) AS component_id
FROM documents LEFT JOIN sz ON sz.doc_id = documents.doc_id LEFT JOIN reach ON reach.a = documents.doc_id
GROUP BY documents.doc_id
"""}
