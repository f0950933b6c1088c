"""Line dedup with filters of once-seen and twice-seen line hashes (operator 7).

Pass 1 puts the hash of every long line of every document into two filters:
the first insertion sets the bits of the once-seen one, a further one those of
the twice-seen one.  Pass 2 sends on only lines that the twice-seen filter
suspects.  They are confirmed exactly by a 128-bit digest of the key: the
documents that hold it are counted and the largest id is the one that keeps it.

Defined results: a null or empty text is one empty line and its kept text is
''; rows that repeat a doc_id count as one document and lose the same lines;
rows without doc_id are left as they are and not counted; an empty table gives
an empty one.  A line of any length is one key.  Filters have a bounded size;
a full one suspects more lines, and the exact step decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store, table, tidy
from .sketch import POSITIONS, build_filter, positions, slabs_for
from .spans import U64, blocks

SPACE = b" \t\n\v\f\r"
FLUSH = 400_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line (UTF-8), or None where it is too short."""
    key = line.strip(SPACE).lower()  # bytes.lower touches A-Z only
    if len(key) < min_chars or not key.isascii() and len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return key


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    return {k for line in text.split(b"\n") if len(line) >= min_chars and (k := line_key(line, min_chars)) is not None}


def _rows(batch: pa.RecordBatch, text: str):
    """(first row, rows' bytes) by blocks."""
    for at, part in blocks(batch.column(text)):
        off, data = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + len(part) + 1].tolist(), part.buffers()[2]
        raw = data.to_pybytes() if data is not None and len(data) < 1 << 22 else memoryview(data or b"")
        yield at, [bytes(raw[a:b]) for a, b in zip(off, off[1:], strict=False)]


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and n_lines and n_dropped (replacing columns of these names)."""
    spark = docs.sparkSession
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")
    n_lines = slim.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    n_slabs = slabs_for(n_lines)

    @tidy
    def insert(batches):
        held: list[int] = []
        for batch in batches:
            for _, rows in _rows(batch, "text"):
                for row in rows:
                    held.extend(map(xxhash.xxh3_64_intdigest, _keys(row, min_chars)))
                if len(held) > FLUSH:
                    yield positions(np.array(held, U64), n_slabs)
                    held = []
        if held:
            yield positions(np.array(held, U64), n_slabs)

    twice = spark.sparkContext.broadcast(build_filter(slim.select("text").mapInArrow(insert, POSITIONS), n_slabs, 2))

    @tidy
    def suspect(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for at, rows in _rows(batch, "text"):
                keys, whose = [], []
                for i, row in enumerate(rows):
                    own = _keys(row, min_chars)
                    keys.extend(own)
                    whose.extend([ids[at + i]] * len(own))
                if keys:
                    hit = np.flatnonzero(twice.value.test(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), U64, len(keys)))).tolist()
                    yield pa.RecordBatch.from_arrays([
                        pa.array([whose[i] for i in hit], pa.int64()),
                        pa.array([hashlib.sha256(keys[i]).digest()[:16] for i in hit], pa.binary())], ["id", "line"])

    suspects = store(slim.mapInArrow(suspect, "id long, line binary"), "suspect-lines")
    repeated = suspects.groupBy("line").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")) \
        .filter(F.col("n") >= min_docs).drop("n")
    lost = suspects.join(repeated, "line").filter("id < keeper").groupBy(F.col("id").alias("__ld_id")) \
        .agg(F.collect_set("line").alias("__ld_lost"))

    kept = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped")]
    schema = T.StructType([*kept, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    marked = docs.select(*(f"`{f.name}`" for f in kept)).join(lost, F.col(key).cast("long") == F.col("__ld_id"), "left").drop("__ld_id")

    @tidy
    def drop(batches):
        for batch in batches:
            gone = batch.column("__ld_lost")
            names = [f.name for f in kept]
            for at, rows in _rows(batch, text):
                texts, lines, dropped = [], [], []
                for row, lose in zip(rows, gone.slice(at, len(rows)).to_pylist(), strict=True):
                    parts = row.split(b"\n")
                    stay = parts
                    if lose:
                        lose = set(lose)
                        stay = [x for x in parts if (k := line_key(x, min_chars)) is None or hashlib.sha256(k).digest()[:16] not in lose]
                    lines.append(len(parts))
                    dropped.append(len(parts) - len(stay))
                    texts.append(b"\n".join(stay))
                new = pa.array(texts, pa.binary()).cast(pa.string())
                columns = [new if n == text else batch.column(n).slice(at, len(rows)) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                                                 [*names, "n_lines", "n_dropped"])

    return marked.mapInArrow(drop, schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES = {"op7_line_dedup": """
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
cut AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM parts),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM cut),
rep AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, rep.k IS NOT NULL AND doc_id < keeper AS gone FROM keyed LEFT JOIN rep USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""}
