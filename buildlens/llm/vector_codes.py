"""Product codes of integer vectors, with memoised grid cells (operator 12).

Components become floor(scale * x).  A vector is cut into ``PARTS`` equal
consecutive parts, and every part position has a codebook of ``ENTRIES`` rows,
which starts as that part of the vectors with the smallest keys.  Each round
assigns all parts to their nearest entries and moves the entries to the floor
of their parts' mean; a last assignment gives the codes.

The nearest entry is found by the coarse cell that a part lies in.  An entry is
dominated across the cell's box if another entry's largest distance to the box
is below its own least distance; the entries that aren't are kept under the
cell (per task and round), and only these are evaluated, exactly and in
integers.  A cell's width is a power of two from the codebook's spread and
changes work, not results.

A codebook has a fixed size, so it is the only thing that is broadcast; a
round sends one row per used (part, entry) and task to a partial sum.

Defined results: rows whose vector is null, or holds null or non-finite
components, are dropped.  A kept row takes part if its vector is as long as
that of the smallest key and its components stay below ``LIMIT``; any other
kept row has null code and error.  That length must be a multiple of
``PARTS``, or no row takes part.  A null key sorts last; rows that repeat a
key start the codebook in order of their components; with fewer rows than
``ENTRIES`` the codebook has as many entries.  Null labels are one label.
An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 24          # of a component's absolute value, so that all sums stay in 64 bits
CACHED_CELLS = 200_000   # per part position and task; the cache is emptied beyond


class CellCache:
    """Nearest entries of one part position: coarse cell -> entries not dominated across its box."""

    def __init__(self, book: np.ndarray):
        self.book = book
        spread = float(book.std(axis=0).mean()) if len(book) else 0.0
        self.shift = max(0, round(np.log2(max(1.0, spread / 2))))
        self.clear()

    def clear(self):
        self.known: dict[bytes, int] = {}
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, cells: np.ndarray):
        """Entries for new cells (a row each)."""
        low = (cells << self.shift)[:, None, :]
        high = low + (1 << self.shift) - 1
        below, above = low - self.book, self.book - high
        least = (np.maximum(0, np.maximum(below, above)) ** 2).sum(axis=2)
        most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
        keep = least <= most.min(axis=1, keepdims=True)
        count = keep.sum(axis=1)
        begin = len(self.flat) + np.cumsum(count) - count
        base = len(self.count)
        self.known.update(zip(map(bytes, cells), range(base, base + len(cells)), strict=True))
        self.start, self.count = np.append(self.start, begin), np.append(self.count, count)
        self.flat = np.append(self.flat, np.nonzero(keep)[1])

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of ``parts``; ties go to the lower entry."""
        coarse = parts >> self.shift
        raw = np.ascontiguousarray(coarse).view(f"V{coarse.shape[1] * 8}").ravel()
        _, first, which = np.unique(raw, return_index=True, return_inverse=True)
        cells = coarse[first]
        if len(self.known) > CACHED_CELLS:
            self.clear()
        new = np.array([i for i, c in enumerate(map(bytes, cells)) if c not in self.known], np.int64)
        for cut in range(0, len(new), 4096):
            self._add(cells[new[cut:cut + 4096]])
        place = np.fromiter((self.known[c] for c in map(bytes, cells)), np.int64, len(cells))[which]
        count = self.count[place]
        begin = np.cumsum(count) - count
        row = np.repeat(np.arange(len(parts)), count)
        entry = self.flat[np.arange(int(count.sum())) - begin[row] + self.start[place][row]]
        apart = ((parts[row] - self.book[entry]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(apart, begin)
        hit = np.flatnonzero(apart == least[row])
        return entry[hit[np.unique(row[hit], return_index=True)[1]]], least


def _vectors(batch: pa.RecordBatch, width: int):
    """The rows of a batch's list column ``v`` as one integer matrix."""
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)


def _assigned(vectors: np.ndarray, books: list[CellCache]) -> tuple[np.ndarray, np.ndarray]:
    """(entries, squared distances), rows x parts."""
    d = vectors.shape[1] // len(books)
    found = [cache.nearest(vectors[:, p * d:(p + 1) * d]) for p, cache in enumerate(books)]
    return np.stack([e for e, _ in found], axis=1), np.stack([s for _, s in found], axis=1)


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts x entries x width) after one round."""
    parts, entries, d = books.shape

    def sums(batches):
        caches, total, count = [CellCache(b) for b in books], np.zeros((parts, entries, d), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if len(batch):
                vectors = _vectors(batch, parts * d)
                chosen, _ = _assigned(vectors, caches)
                for p in range(parts):
                    np.add.at(total[p], chosen[:, p], vectors[:, p * d:(p + 1) * d])
                    count[p] += np.bincount(chosen[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": count[part, entry],
                                          "s": pa.array(list(total[part, entry]), pa.list_(pa.int64()))})

    found = rows.select("v").mapInArrow(sums, "part int, entry int, n long, s array<long>") \
        .groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(d))).collect()
    books = books.copy()
    for r in found:
        books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(d)]
    return books


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error), a row per kept row; the codebooks, parts x entries x width)."""
    spark, e = vectors.sparkSession, F.col("e")
    whole = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("e")) \
        .filter(e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    floors = F.transform(e, lambda x: F.floor(x * scale))
    kept = store(whole.select("id", "label", F.size("e").alias("width"), F.forall(e, lambda x: F.abs(x * scale) < LIMIT).alias("small"), floors.alias("v")), "integer-vectors")
    first = kept.filter("small").orderBy(F.col("id").asc_nulls_last(), "v").select("width", "v").limit(entries).collect()
    width = first[0]["width"] if first else 0
    books = np.zeros((parts, 0, 0), np.int64)
    fits = F.col("small") & (F.col("width") == width)
    if width and width % parts == 0:
        if any(r["width"] != width for r in first):
            first = kept.filter(fits).orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
        books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
        for _ in range(rounds):
            books = _moved(kept.filter(fits), books)
    else:
        fits = F.lit(False)
    final = books

    def code(batches):
        caches = [CellCache(b) for b in final]
        for batch in batches:
            if len(batch):
                chosen, apart = _assigned(_vectors(batch, width), caches)
                text = ["".join(f"{x:02x}" for x in row) for row in chosen.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(apart.sum(axis=1))],
                                                 ["id", "label", "code", "error"])

    kind = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    coded = kept.filter(fits).select("id", "label", "v").mapInArrow(code, f"{kind}, code string, error long")
    rest = kept.filter(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return store(coded.unionByName(rest), "vector-codes"), final


def books_digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))) \
        .select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _round(n: int) -> str:
    """Assignment by the codebook b{n} and the codebook b{n+1} after it."""
    return f"""
a{n} AS MATERIALIZED (
  SELECT vec_id, p, (min(d * 64 + e) % 64) AS e, min(d * 64 + e) // 64 AS d FROM (
    SELECT v.vec_id, v.p, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM part v JOIN b{n} b ON v.p = b.p) GROUP BY vec_id, p),
b{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(any_value(m.x), any_value(b.x)) AS x FROM b{n} b LEFT JOIN (
    SELECT p, e, list(floor_of ORDER BY i) AS x FROM (
      SELECT v.p, a.e, i, ((sum(v.x[i])::BIGINT - ((sum(v.x[i])::BIGINT % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_of
      FROM part v JOIN a{n} a ON v.vec_id = a.vec_id AND v.p = a.p, unnest(range(1, len(v.x) + 1)) AS u(i) GROUP BY v.p, a.e, i)
    GROUP BY p, e) m ON m.p = b.p AND m.e = b.e GROUP BY b.p, b.e)"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {"op12_vector_codes": f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM kept, range(16) AS t(p)),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM part
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),{_round(0)},{_round(1)},
a2 AS MATERIALIZED (
  SELECT vec_id, p, (min(d * 64 + e) % 64) AS e, min(d * 64 + e) // 64 AS d FROM (
    SELECT v.vec_id, v.p, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM part v JOIN b2 b ON v.p = b.p) GROUP BY vec_id, p),
coded AS (
  SELECT kept.vec_id, label, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM kept JOIN a2 ON a2.vec_id = kept.vec_id GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM coded
"""}
