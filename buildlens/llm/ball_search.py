"""Exact ranked lexical search with sparse ball trees (operator 13).

A document is a sparse vector x over terms, x(t) = (1000000000 tf) div
(1000 tf + 20 m), an item is one with the weights w(t) of its terms, and a score
is their inner product, in 64-bit integers.  Only terms of items can add to a
score, so documents are read once into their (term, tf) lists over those terms.

Each task cuts its documents into blocks of ``BLOCK`` and builds a ball tree per
block, by two means.  A node has the centroid of its documents and their radius
around it, upwards only, as no weight is negative: r over all terms together,
and r(t) in every term alone.  An inner product below a node is at most
w.centroid + |w| r, and at most w.(centroid + r(t)); radii and bounds are rounded
up.  A search takes nodes by descending bound, scores the documents of leaves
exactly, and ends where the bound is below the k-th score so far; an equal bound
is still opened, as ties go by key.  The best k of a task are carried from block
to block, so later blocks are pruned by earlier ones.

Items are taken in blocks of at most ``ITEMS`` rows and ``ITEM_BYTES`` of text (or
one longer item), so what is broadcast is bounded, however many there are.

Defined results: null texts and texts without a term hold nothing and are in
no result; an item without text or terms has no rows; repeated document rows are
ranked each, a null key after all others of its score; rows that repeat an
item id are ranked each for itself; empty tables give an empty result.  Other
columns are ignored.  Texts of any length are read whole.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store, table
from .spans import blocks, span_hashes
from .words import words

K, BLOCK, LEAF, ROUNDS = 50, 8192, 32, 5
ITEMS, ITEM_BYTES = 2000, 4 << 20

#: What separates terms: bytes 00-2F, 3A-40, 5B-60 and 7B-7F.
SEPARATOR = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    SEPARATOR[_low:_high + 1] = True

#: Slack of rounded-up radii and bounds, far above the error of sums of doubles.
UP = 1 + 1e-9


def term_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every term of a block of texts, in order."""
    raw, _, starts, ends, row = words(texts, SEPARATOR)
    return span_hashes(raw, starts, ends), row


def _postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(id, n, at, tf): terms with repeats, and places in ``terms`` (ascending) with counts; documents without terms go."""

    def scan(batches):
        for batch in batches:
            for first, part in blocks(batch.column(1)):
                hashes, row = term_rows(part)
                n = np.bincount(row, minlength=len(part))
                place = np.searchsorted(terms, hashes)
                hit = place < len(terms)
                hit[hit] = terms[place[hit]] == hashes[hit]
                key, tf = np.unique(row[hit] * len(terms) + place[hit], return_counts=True)
                of, at = key // max(1, len(terms)), key % max(1, len(terms))
                off = pa.array(np.searchsorted(of, np.arange(len(part) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(part)), pa.array(n),
                    pa.ListArray.from_arrays(off, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(tf.astype(np.int64)))],
                    ["id", "n", "at", "tf"]).filter(pa.array(n > 0))

    return store(docs.mapInArrow(scan, "id long, n long, at array<int>, tf array<long>"), "term-postings")


def _frequencies(postings: DataFrame, n_terms: int) -> np.ndarray:
    """The number of documents that hold each term."""

    def count(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("at").flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["at", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in postings.select("at").mapInArrow(count, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():
        out[r["at"]] = r["df"]
    return out


class Sparse:
    """Rows of a sparse matrix, none empty: places and values of row r are at[off[r]:off[r+1]], x likewise."""

    def __init__(self, off: np.ndarray, at: np.ndarray, x: np.ndarray):
        self.off, self.at, self.x = off, at, x

    def spans(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places into at and x, place in ``rows`` of each)."""
        size = (self.off[1:] - self.off[:-1])[rows]
        first = np.cumsum(size) - size
        of = np.repeat(np.arange(len(rows)), size)
        return np.arange(int(size.sum())) - first[of] + self.off[rows][of], of

    def take(self, rows: np.ndarray) -> Sparse:
        spot, _ = self.spans(rows)
        return Sparse(np.append(0, np.cumsum((self.off[1:] - self.off[:-1])[rows])), self.at[spot], self.x[spot])

    def dot(self, low: int, high: int, dense: np.ndarray) -> np.ndarray:
        """Inner products of the rows low to high with a dense vector."""
        first, last = self.off[low], self.off[high]
        return np.add.reduceat(self.x[first:last] * dense[self.at[first:last]], self.off[low:high] - first)


class BallTree:
    """Nodes in creation order; node 0 is the root.  A node holds rows low:high of ``rows``, which are the given ones in ``order``."""

    def __init__(self, rows: Sparse, n_terms: int):
        self.rows, self.n_terms = rows, n_terms
        n = len(rows.off) - 1
        self.order = np.arange(n)
        self.low, self.high, self.child, self.ball = [0], [n], [0], []
        node = 0
        while node < len(self.low):
            low, high = self.low[node], self.high[node]
            own = self.order[low:high]
            spot, of = rows.spans(own)
            apart = self._ball(spot, of, len(own))
            if high - low > LEAF:
                cut = self._split(low, own, spot, of, apart)
                self.child[node] = len(self.low)
                self.low += [low, low + cut]
                self.high += [low + cut, high]
                self.child += [0, 0]
            node += 1
        self.rows = rows.take(self.order)

    def _ball(self, spot: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Adds terms, centroid, centroid + r(t) and r of a node; the squared distance to the centroid of each row."""
        at, x = self.rows.at[spot], self.rows.x[spot].astype(np.float64)
        centre, top = np.bincount(at, x, self.n_terms) / n, np.zeros(self.n_terms)
        np.maximum.at(top, at, x)
        upward = np.bincount(of, np.maximum(x - centre[at], 0) ** 2, n)
        held = np.flatnonzero(top)
        self.ball.append((held, centre[held], top[held], np.sqrt(upward.max()) * UP))
        return np.bincount(of, (x - centre[at]) ** 2 - centre[at] ** 2, n) + centre @ centre

    def _split(self, low: int, own: np.ndarray, spot: np.ndarray, of: np.ndarray, apart: np.ndarray) -> int:
        """Orders the node's rows, order[low:], by two means that start at two far rows; the number of those at the first."""
        at, x, n = self.rows.at[spot], self.rows.x[spot].astype(np.float64), len(own)

        def gain(centre: np.ndarray) -> np.ndarray:
            """Half of |x|^2 - |x - c|^2 of each row."""
            return np.bincount(of, x * centre[at], n) - centre @ centre / 2

        def mean(rows: np.ndarray) -> np.ndarray:
            mine = rows[of]
            return np.bincount(at[mine], x[mine], self.n_terms) / rows.sum()

        norm = np.bincount(of, x * x, n) / 2
        one = gain(mean(np.arange(n) == np.argmax(apart)))
        two = gain(mean(np.arange(n) == np.argmax(norm - one)))
        for _ in range(ROUNDS):
            first = one > two
            if first.all() or not first.any():
                break
            one, two = gain(mean(first)), gain(mean(~first))
        self.order[low:low + n] = own[np.argsort(two - one, kind="stable")]
        cut = int((one > two).sum())
        return cut if 0 < cut < n else n // 2

    def bound(self, node: int, dense: np.ndarray, norm: float) -> float:
        """No document below ``node`` scores more."""
        at, centre, top, radius = self.ball[node]
        w = dense[at]
        return min(float(w @ centre) + norm * radius, float(w @ top)) * UP + 1e-3


def search(tree: BallTree, keys: np.ndarray, weights: np.ndarray, k: int, best: list) -> int:
    """Adds to ``best`` (a heap of (score, -key) of at most k) from one tree; the documents scored.

    ``weights``: the item's integer weight of every term.
    """
    dense = weights.astype(np.float64)
    norm = float(np.sqrt(dense @ dense)) * UP
    open_, scored = [(-tree.bound(0, dense, norm), 0)], 0
    while open_:
        bound, node = heapq.heappop(open_)
        if -bound < 1 or len(best) == k and -bound < best[0][0]:
            break
        if tree.child[node]:
            for c in (tree.child[node], tree.child[node] + 1):
                heapq.heappush(open_, (-tree.bound(c, dense, norm), c))
            continue
        low, high = tree.low[node], tree.high[node]
        score = tree.rows.dot(low, high, weights)
        scored += high - low
        least = best[0][0] if len(best) == k else 1
        for r in np.flatnonzero(score >= least).tolist():
            entry = (int(score[r]), -int(keys[tree.order[low + r]]))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return scored


#: Stands for a null key in a heap: after all others.
NO_KEY = np.iinfo(np.int64).max


def _ranked(postings: DataFrame, items: list[np.ndarray], weight: np.ndarray, m_of, k: int) -> DataFrame:
    """(item, id, score): the best k of every item, of all tasks, ranked."""
    n_terms = len(weight)

    def best_of_task(batches):
        best: list[list] = [[] for _ in items]
        held, size = [], 0

        def take():
            rows = pa.Table.from_batches(held).combine_chunks()
            at, tf = rows.column("at").combine_chunks(), rows.column("tf").combine_chunks()
            off = np.append(0, np.cumsum(at.value_lengths().to_numpy()))
            m = np.repeat(m_of(rows.column("n").to_numpy()), np.diff(off))
            tf = tf.flatten().to_numpy()
            tree = BallTree(Sparse(off, at.flatten().to_numpy().astype(np.int64), 1_000_000_000 * tf // (1000 * tf + 20 * m)), n_terms)
            keys = rows.column("id").fill_null(NO_KEY).to_numpy()
            for heap, terms in zip(best, items, strict=True):
                dense = np.zeros(n_terms, np.int64)
                dense[terms] = weight[terms]
                search(tree, keys, dense, k, heap)

        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                if size and size + len(part) > BLOCK:
                    take()
                    held, size = [], 0
                held.append(part)
                size += len(part)
        if size:
            take()
        found = [(i, None if -key == NO_KEY else -key, score) for i, heap in enumerate(best) for score, key in sorted(heap, reverse=True)]
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], ["item", "id", "score"])

    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    found = postings.filter(F.size("at") > 0).mapInArrow(best_of_task, "item long, id long, score long")
    # best of groups of tasks first, so that an item's window stays small
    near = found.withColumn("task", F.spark_partition_id() % 256)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("item", "task").orderBy(*order))).filter(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k) \
        .select("item", "rank", "id", "score")


def _item_blocks(items: DataFrame, item: str, text: str):
    """(ids, terms of each): runs of items of a bounded size, read one partition at a time."""
    ids, texts, size = [], [], 0

    def terms():
        hashes, row = term_rows(pa.array(texts, pa.large_string()))
        return ids, [np.unique(hashes[row == r]) for r in range(len(texts))]

    for r in items.select(F.col(item).alias("i"), F.col(text).alias("t")).filter("t is not null").toLocalIterator():
        if texts and (len(texts) == ITEMS or size + len(r["t"]) > ITEM_BYTES):
            yield terms()
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"])
    if texts:
        yield terms()


def ranked_search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", k: int = K) -> DataFrame:
    """(item, rank, id, score): the k best documents of every item."""
    spark = docs.sparkSession
    read = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    kind = items.schema[item].dataType
    out = spark.createDataFrame([], f"item {kind.simpleString()}, rank int, id long, score long")
    for ids, own in _item_blocks(items, item, item_text):
        terms = np.unique(np.concatenate(own))
        postings = _postings(read, terms)
        n_docs, total = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs or not len(terms):
            continue
        df = _frequencies(postings, len(terms))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)
        found = _ranked(postings, [np.searchsorted(terms, t) for t in own], weight, lambda n, d=n_docs, t=total: 50 + 50 * n * d // t, k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, name {kind.simpleString()}")
        out = out.unionByName(store(found.join(names, "item").select(F.col("name").alias("item"), "rank", "id", "score"), "ranked"))
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")) \
        .select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLES = {"op13_ranked_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*)::BIGINT AS big_n, sum(len(ts))::BIGINT AS big_l FROM d WHERE len(ts) > 0),
it AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS t FROM benchmark),
tf AS (
  SELECT doc_id, len(any_value(ts)) AS n, t, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS t FROM d)
  WHERE t IN (SELECT t FROM it) GROUP BY doc_id, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s GROUP BY t, big_n),
x AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)) AS x FROM tf, s),
sc AS (
  SELECT item_id, doc_id, CAST(sum(w * x) AS BIGINT) AS score FROM it JOIN w USING (t) JOIN x USING (t) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM sc WHERE score > 0 QUALIFY rank <= 50
"""}
