"""Repeated byte strings by column-wise suffix sorting of many documents (operator 6).

Which 400-byte windows also start elsewhere is decided by sorting suffixes of
all documents.  So that Spark can deal the work, each window is assigned to its
anchor, the leftmost 32-byte gram of lowest hash inside it: equal windows have
equal anchors at equal offsets, so only regions (the runs of windows of one anchor, with their
bytes) around grams that occur twice are sorted at all, and only with the regions of the same gram.

``repeated_windows`` sorts a collection of regions column by column from the
right, aligned at their anchors.  In each round every region inserts one
symbol.  With a symbol taken as (column, byte), suffixes of different columns
never interleave, so the part of the collection's Burrows-Wheeler transform that
a round writes is read by the next round alone: the round permutes the order of
suffixes by a stable sort of that column of symbols and updates the common
prefixes of neighbours by range minima.  The columns are read in sequence, once.  They are
held in the task's memory, as folders of a machine may not be used, and a
batch of regions has a bounded size.

Equal regions are one string with a count: two of them repeat all their
windows.  A gram with more different regions than a task should sort (``HOT``) is dealt anew: its
windows are cut into classes of neighbouring offsets, each grouped by the bytes
that all windows of the class contain, at last window by window.  So nothing is
capped, and copies of a passage never meet in one task in numbers.

Defined results: null and empty texts have no bytes; texts shorter than the
window lose nothing; a row is known by id and text, and every row is an
occurrence of its own, so repeated rows remove each other; matches never cross
rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, store, table
from .sketch import POSITIONS, build_filter, positions, slabs_for
from .spans import U64, blocks, mix, utf8

GRAM = 32
HOT = 20_000       # different regions of one gram that one task sorts (15 MB)
CLASSES = (46, 1)  # widths of the offset classes that hot grams are dealt by
BATCH = 20_000     # regions sorted together
SEGMENT = 1 << 20


# ---- anchors ----

def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of the 32 bytes that start at each place."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, U64)
    data, words = raw.tobytes(), np.empty(len(raw) - 7, U64)
    for r in range(8):
        count = (len(raw) - r) // 8
        words[r::8] = np.frombuffer(data, "<u8", count, r)
    total = np.zeros(n, U64)
    for j, c in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
        total += mix(words[8 * j:8 * j + n] * U64(c) + U64(j))
    return mix(total)


def anchors(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, anchor) of every region of the rows that tile ``raw``; and the gram hashes are of ``raw``."""
    span = width - GRAM + 1
    grams = gram_hashes(raw)
    if len(raw) < width:
        none = np.zeros(0, np.int64)
        return none, none, none, grams
    place = np.arange(len(grams), dtype=U64)
    key = (grams & ~U64((1 << 22) - 1)) | place
    padded = np.concatenate([key, np.full(-len(key) % span + span, 0xFFFFFFFFFFFFFFFF, U64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(raw) - width + 1
    anchor = (np.minimum(back[:n], ahead[span - 1:span - 1 + n]) & U64((1 << 22) - 1)).astype(np.int64)
    row = np.searchsorted(off, np.arange(n), side="right") - 1
    fits = np.flatnonzero(np.arange(n) + width <= off[row + 1])
    if not len(fits):
        none = np.zeros(0, np.int64)
        return none, none, none, grams
    new = np.ones(len(fits), bool)
    new[1:] = (anchor[fits][1:] != anchor[fits][:-1]) | (row[fits][1:] != row[fits][:-1])
    head = np.flatnonzero(new)
    first, count = fits[head], np.diff(np.append(head, len(fits)))
    return first, count, anchor[first], grams


def regions(part: pa.Array, width: int):
    """(row, first window in the row, windows, anchor's offset in the region, gram hash, begin in raw, raw) of blocks of rows."""
    raw, off = utf8(part)
    if len(raw) <= 2 * SEGMENT:
        yield 0, raw, off, *anchors(raw, off, width)
        return
    for r in range(len(off) - 1):  # a long text in segments that share width - 1 bytes
        for at in range(int(off[r]), int(off[r + 1]), SEGMENT):
            piece = raw[at:min(int(off[r + 1]), at + SEGMENT + width - 1)]
            yield r, piece, np.array([at - off[r], 0]), *anchors(piece, np.array([0, len(piece)]), width)


# ---- column-wise sorting ----

def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last], ends included."""
    out = values[last].copy()
    size = last - first + 1
    level, step, todo = values, 1, np.flatnonzero(size > 1)
    while len(todo):
        if 2 * step > len(values):
            now = np.ones(len(todo), bool)
        else:
            now = size[todo] < 2 * step
        t = todo[now]
        out[t] = np.minimum(level[first[t]], level[last[t] - step + 1])
        todo = todo[~now]
        if len(todo):
            level = np.minimum(level[:len(level) - step], level[step:])
            step *= 2
    return out


def _without(order: np.ndarray, upto: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order without some suffixes; a neighbour's common prefix is the least over those that went."""
    left = np.flatnonzero(keep)
    if not len(left):
        return order[:0], upto[:0]
    return order[left], np.minimum.reduceat(upto[:left[-1] + 1], np.concatenate([[0], left[:-1] + 1]))


def repeated_windows(strings: list[bytes], anchor: np.ndarray, width: int) -> list[np.ndarray]:
    """For each string, whether the window at each of its offsets starts with equal bytes in another string, at the same column.

    ``upto`` holds, for each suffix in order, the column where it first differs
    from its predecessor, so a common prefix never has to be lengthened.
    """
    size = np.array([len(s) for s in strings])
    start, end = -anchor, size - anchor
    low, high = int(start.min()), int(end.max())
    columns = np.zeros((high - low, len(strings)), np.uint8)
    for i, s in enumerate(strings):
        columns[start[i] - low:end[i] - low, i] = np.frombuffer(s, np.uint8)
    hit = np.zeros((len(strings), int((size - width).max()) + 1), bool)
    joins = np.argsort(-end, kind="stable")
    waiting = 0
    order, upto = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for c in range(high - 1, low - 1, -1):
        keep = start[order] <= c
        if c % 8 == 0 and len(order):
            best = np.maximum(upto, np.append(upto[1:], c + 1))
            keep &= best >= start[order] + width  # matches only get shorter further left
        if not keep.all():
            order, upto = _without(order, upto, keep)
        more = waiting
        while more < len(joins) and end[joins[more]] == c + 1:
            more += 1
        if more > waiting:  # their suffixes are empty so far, and sort first
            if len(upto):
                upto[0] = c + 1
            order = np.concatenate([joins[waiting:more], order])
            upto = np.concatenate([np.full(more - waiting, c + 1), upto])
            waiting = more
        if not len(order):
            continue
        symbol = columns[c - low, order]
        to = np.argsort(symbol, kind="stable")
        symbol, order = symbol[to], order[to]
        fresh = np.full(len(to), c)
        same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        if len(same):
            fresh[same] = _range_min(upto, to[same - 1] + 1, to[same])
        upto = fresh
        far = upto >= c + width
        if far.any():
            far[:-1] |= far[1:]
            who = order[far]
            hit[who, c - start[who]] = True
    return [hit[i, :size[i] - width + 1] for i in range(len(strings))]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


# ---- the job ----

OCCURRENCE = "gram long, rid binary, anchor int, n int, id long, th long, at long, body binary"
REGION = "gram long, rid binary, anchor int, n int, many long, body binary"
HITS = "rid binary, lo int, hi int"


def _occurrences(docs: DataFrame, width: int) -> DataFrame:
    """Stored regions whose gram may occur twice; the bytes are given once a batch."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_slabs = slabs_for(int(size) // ((width - GRAM) // 2) + 1)

    def insert(batches):
        held, n = [], 0
        for batch in batches:
            for _, part in blocks(batch.column(0)):
                for _, _, _, first, _, anchor, grams in regions(part, width):
                    if len(first):
                        held.append(grams[anchor])
                        n += len(first)
                if n > 300_000:
                    yield positions(np.concatenate(held), n_slabs)
                    held, n = [], 0
        if held:
            yield positions(np.concatenate(held), n_slabs)

    twice = docs.sparkSession.sparkContext.broadcast(build_filter(docs.select("text").mapInArrow(insert, POSITIONS), n_slabs, 2))

    def scan(batches):
        for batch in batches:
            ids, hashes = batch.column("id"), batch.column("th")
            for row0, part in blocks(batch.column("text")):
                for r, raw, off, first, count, anchor, grams in regions(part, width):
                    if not len(first):
                        continue
                    pick = np.flatnonzero(twice.value.test(grams[anchor]))
                    if not len(pick):
                        continue
                    first, count, anchor = first[pick], count[pick], anchor[pick]
                    data = raw.tobytes()
                    body = [data[a:b] for a, b in zip(first.tolist(), (first + count + width - 1).tolist(), strict=True)]
                    rid = [xxhash.xxh3_128_digest(b) for b in body]
                    if len(off) == 2 and off[1] == 0:  # a segment: off[0] is its place in the row
                        row, at = np.full(len(first), r), first + off[0]
                    else:
                        row = np.searchsorted(off, first, side="right") - 1
                        at = first - off[row]
                    seen: set[bytes] = set()
                    given = [None if k in seen or seen.add(k) else b for k, b in zip(rid, body, strict=True)]
                    take = pa.array(row + row0)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(grams[anchor].view(np.int64)), pa.array(rid, pa.binary()), pa.array((anchor - first).astype(np.int32)),
                        pa.array(count.astype(np.int32)), ids.take(take), hashes.take(take), pa.array(at), pa.array(given, pa.binary())],
                        ["gram", "rid", "anchor", "n", "id", "th", "at", "body"])

    return store(docs.mapInArrow(scan, OCCURRENCE), "regions")


def _sort_task(width: int):
    """mapInArrow over regions in order of gram: (rid, lo, hi), runs of windows that another region holds."""

    def run(batches):
        rid, body, anchor, last = [], [], [], None
        for batch in batches:
            for g, r, a, b in zip(*(batch.column(c).to_pylist() for c in ("gram", "rid", "anchor", "body")), strict=True):
                if len(rid) >= BATCH and g != last:
                    yield from _sorted(rid, body, anchor, width)
                    rid, body, anchor = [], [], []
                last = g
                rid.append(r)
                body.append(b)
                anchor.append(a)
        yield from _sorted(rid, body, anchor, width)

    return run


def _sorted(rid: list, body: list, anchor: list, width: int):
    if len(rid) < 2:
        return
    out: tuple[list, list, list] = ([], [], [])
    for r, flags in zip(rid, repeated_windows(body, np.array(anchor), width), strict=True):
        lo, hi = _runs(flags)
        out[0].extend([r] * len(lo))
        out[1].append(lo)
        out[2].append(hi)
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(np.concatenate(out[1]).astype(np.int32)),
                                          pa.array(np.concatenate(out[2]).astype(np.int32))], ["rid", "lo", "hi"])


def _deal(hot: DataFrame, step: int, width: int) -> DataFrame:
    """Regions of hot grams by classes of ``step`` offsets: parent, shift and the class's own region."""

    def deal(batches):
        for batch in batches:
            out = {k: [] for k in ("parent", "shift", "gram", "rid", "anchor", "n", "body")}
            for g, r, a, n, b in zip(*(batch.column(c).to_pylist() for c in ("gram", "rid", "anchor", "n", "body")), strict=True):
                # a window's class is set by its offset from the anchor, not from the region
                first = 0
                while first < n:
                    kind = (a - first) // step
                    stop = min(n, a - kind * step + 1)
                    # all windows of the class hold these bytes, whichever of them a region has
                    core = b[a - kind * step:a - kind * step - step + 1 + width]
                    body = b[first:stop - 1 + width]
                    key = xxhash.xxh3_64_intdigest(core + g.to_bytes(8, "little", signed=True) + kind.to_bytes(4, "little", signed=True))
                    out["parent"].append(r)
                    out["shift"].append(first)
                    out["gram"].append(key - (1 << 64) if key >> 63 else key)
                    out["rid"].append(xxhash.xxh3_128_digest(body + kind.to_bytes(4, "little", signed=True)))
                    out["anchor"].append(a - first)
                    out["n"].append(stop - first)
                    out["body"].append(body)
                    first = stop
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("parent", pa.binary()), ("shift", pa.int32()), ("gram", pa.int64()), ("rid", pa.binary()), ("anchor", pa.int32()),
                ("n", pa.int32()), ("body", pa.binary())]))

    return hot.select("gram", "rid", "anchor", "n", "body").mapInArrow(
        deal, "parent binary, shift int, gram long, rid binary, anchor int, n int, body binary")


def _hits(found: DataFrame, width: int, classes: tuple[int, ...], hot_limit: int) -> DataFrame:
    """(rid, lo, hi) for regions (REGION): windows that occur again in equal or other regions."""
    spark = found.sparkSession
    whole = found.filter("many > 1").select("rid", F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"))
    if not classes:
        return whole
    kinds = store(found.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "gram-kinds")
    shared = found.join(kinds, "gram")
    some = shared.filter(F.col("kinds") <= hot_limit).select("gram", "rid", "anchor", "body") \
        .repartition(partitions(spark), "gram").sortWithinPartitions("gram").mapInArrow(_sort_task(width), HITS)
    out = whole.unionByName(some)
    if kinds.filter(F.col("kinds") > hot_limit).limit(1).count():
        hot = shared.filter(F.col("kinds") > hot_limit)
        dealt = store(_deal(hot, classes[0], width), "hot-regions")
        inner = _merge(dealt.withColumn("more", F.lit(1).cast("long")))
        below = _hits(inner, width, classes[1:], hot_limit)
        back = dealt.select("parent", "shift", "rid").join(below, "rid") \
            .select(F.col("parent").alias("rid"), (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi"))
        out = out.unionByName(back)
    return out


def _merge(rows: DataFrame) -> DataFrame:
    """One row per different region, with its number of occurrences."""
    return store(rows.groupBy("rid").agg(F.first("gram").alias("gram"), F.first("anchor").alias("anchor"), F.first("n").alias("n"),
                                         F.sum("more").alias("many"), F.first("body", ignorenulls=True).alias("body")), "different-regions")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 400, hot_limit: int = HOT) -> DataFrame:
    """(id, th, spans): for rows with repeated strings, the [begin, end) that windows cover, as found (they may overlap)."""
    slim = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    seen = _occurrences(slim, width)
    found = _merge(seen.withColumn("more", F.lit(1).cast("long")))
    hits = _hits(found, width, CLASSES, hot_limit)
    cover = seen.select("rid", "id", "th", "at").join(hits, "rid") \
        .select("id", "th", F.struct((F.col("at") + F.col("lo")).alias("a"), (F.col("at") + F.col("hi") + width).alias("b")).alias("span"))
    return store(cover.groupBy("id", "th").agg(F.sort_array(F.collect_set("span")).alias("spans")), "repeated-spans")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 400, hot_limit: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) per row; kept: the remaining bytes."""
    spans = repeated_spans(docs, key, text, width, hot_limit).withColumnRenamed("id", "sid").withColumnRenamed("th", "sth")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    joined = rows.join(spans, rows.id.eqNullSafe(spans.sid) & (rows.th == spans.sth), "left").select("id", "text", "spans")

    def cut(batches):
        for batch in batches:
            spans, out = batch.column("spans"), ([], [], [], [])
            for at, part in blocks(batch.column("text")):
                raw, off = utf8(part)
                data = raw.tobytes()
                for i, (a, b) in enumerate(zip(off.tolist(), off[1:].tolist(), strict=False)):
                    body, kept, done, removed, n = data[a:b], [], 0, 0, 0
                    for s in spans[at + i].as_py() or ():
                        if s["a"] > done or not n:  # a new run
                            kept.append(body[done:s["a"]])
                            n += 1
                            removed += s["b"] - s["a"]
                            done = s["b"]
                        elif s["b"] > done:
                            removed += s["b"] - done
                            done = s["b"]
                    kept.append(body[done:])
                    for x, v in zip(out, (len(body), removed, n, b"".join(kept)), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())],
                                             ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLES: dict[str, str] = {}
