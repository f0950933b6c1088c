"""Near-duplicate vectors by collision counting on one-dimensional projections (operator 3).

Equal vectors of one label are one class.  Each class vector is projected on
``PROJECTIONS`` random directions and every projection is sorted.  A query's
window holds the vectors within ``WINDOW`` of its own projection; pairs that meet in
enough windows are verified by their cosine in double precision.  For unit
vectors at the threshold, at distance d, a projection differs by a normal
deviate of standard deviation d, so the number of collisions is binomial and
the count asked for is the highest that such a pair reaches with probability
``RECALL``; nearer pairs reach it more surely.

A label of more than ``CELL`` classes is cut by the signs of further projections
into cells, in as many independent tables as the same recall needs, so that no
task gets an unbounded group; a pair that meets in several tables counts in
the first.  A cell's task returns per vector the number of its links and one
edge to a root, never the pairs.

Defined results: a vector that is null, empty, zero or holds null or
non-finite components, or whose label or vec_id is null, links with nothing
and is its own component; vectors of different lengths don't link; rows of one
vec_id are vectors of their own that share a component.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, store, table

PROJECTIONS, WINDOW, RECALL, CELL = 32, 0.45, 0.999, 8192


def collisions_asked(threshold: float, projections: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """The highest count that a pair at the threshold reaches with probability ``recall``."""
    from statistics import NormalDist

    chance = 2 * NormalDist(0, (2 - 2 * threshold) ** 0.5).cdf(window) - 1
    tail = 0.0
    for count in range(projections, 0, -1):
        tail += comb(projections, count) * chance**count * (1 - chance) ** (projections - count)
        if tail >= recall:
            return count
    return 1


def tables_for(bits: int, threshold: float, recall: float = RECALL) -> int:
    """Independent tables of ``bits`` signs that bring a pair at the threshold together."""
    if not bits:
        return 1
    same = (1 - np.arccos(threshold) / np.pi) ** bits
    return int(np.ceil(np.log(1 - recall) / np.log1p(-same)))


def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, n))


def count_links(unit: np.ndarray, weight: np.ndarray, earlier: np.ndarray, threshold: float, asked: int) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each vector's links, root) of one cell.

    ``earlier``: the cells of each vector in earlier tables; a pair that shares one is counted there.
    """
    n = len(unit)
    spots = unit @ _directions(unit.shape[1], PROJECTIONS, 1)
    order = np.argsort(spots, axis=0, kind="stable")
    ranked = np.take_along_axis(spots, order, axis=0)
    low = np.stack([np.searchsorted(ranked[:, j], spots[:, j] - WINDOW, "left") for j in range(PROJECTIONS)], axis=1).tolist()
    high = np.stack([np.searchsorted(ranked[:, j], spots[:, j] + WINDOW, "right") for j in range(PROJECTIONS)], axis=1).tolist()
    columns = [np.ascontiguousarray(order[:, j]) for j in range(PROJECTIONS)]
    links, root = np.zeros(n, np.int64), np.arange(n)
    met = np.zeros(n, np.uint8)
    for q in range(n):
        met[:] = 0
        for column, a, b in zip(columns, low[q], high[q], strict=True):
            met[column[a:b]] += 1
        near = np.flatnonzero(met >= asked)
        near = near[near > q]
        if len(near):
            near = near[unit[near] @ unit[q] >= threshold]
        if len(near) and earlier.shape[1]:
            near = near[~(earlier[near] == earlier[q]).any(axis=1)]
        if len(near):
            links[q] += weight[near].sum()
            links[near] += weight[q]
            joined = np.unique(np.append(root[near], root[q]))
            if len(joined) > 1:
                root[np.isin(root, joined)] = joined[0]
    return links, root


def similar_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = 0.93) -> DataFrame:
    """(id, n_links, component_id), a row per row of ``vectors``."""
    e = F.col("e")
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("e")) \
        .withColumn("ok", F.coalesce(fine & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))) \
        .withColumn("h1", F.xxhash64("label", "e")).withColumn("h2", F.xxhash64("e", "label", F.lit(1)))
    classes = store(rows.filter("ok").groupBy("label", "h1", "h2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("e").alias("e")), "vector-classes")
    asked = collisions_asked(threshold)
    many = classes.groupBy("label", F.size("e").alias("dim")).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("bits", F.greatest(F.ceil(F.log2(F.col("n") / CELL)), F.lit(0)).cast("int"))
    placed = classes.withColumn("dim", F.size("e")).join(many, ["label", "dim"])

    def deal(batches):
        for batch in batches:
            columns = batch.to_pydict()
            out = {"label": [], "dim": [], "tab": [], "cell": [], "earlier": [], "node": [], "weight": [], "e": []}
            for name, dim, bits, node, weight, vec in zip(*(columns[c] for c in ("label", "dim", "bits", "node", "weight", "e")), strict=True):
                tables = tables_for(bits, threshold)
                cells = [0]
                if bits:
                    signs = (np.array(vec) @ _directions(dim, bits * tables, 2) > 0).reshape(tables, bits)
                    cells = (signs @ (1 << np.arange(bits))).tolist()
                for t, cell in enumerate(cells):
                    for k, v in zip(out, (name, dim, t, cell, cells[:t], node, weight, vec), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("label", batch.schema.field("label").type), ("dim", pa.int32()), ("tab", pa.int32()), ("cell", pa.int64()),
                ("earlier", pa.list_(pa.int64())), ("node", pa.int64()), ("weight", pa.int64()), ("e", pa.list_(pa.float64()))]))

    def search(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("node")
        dim = cell.column("dim")[0].as_py()
        flat = cell.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        unit = flat.reshape(-1, dim) / np.abs(flat.reshape(-1, dim)).max(axis=1, keepdims=True)
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        earlier = np.array(cell.column("earlier").to_pylist(), np.int64).reshape(len(unit), -1)
        node, weight = cell.column("node").to_numpy(), cell.column("weight").to_numpy()
        links, root = count_links(unit, weight, earlier, threshold, asked)
        hit = links > 0
        return pa.table({"label": cell.column("label").filter(pa.array(hit)), "h": pa.array(node[hit]), "links": pa.array(links[hit]), "root": pa.array(node[root[hit]])})

    kind = classes.schema["label"].dataType.simpleString()
    dealt = placed.select("label", "dim", "bits", "node", "weight", "e").mapInArrow(
        deal, f"label {kind}, dim int, tab int, cell long, earlier array<long>, node long, weight long, e array<double>")
    found = store(dealt.groupBy("label", "dim", "tab", "cell").applyInArrow(search, f"label {kind}, h long, links long, root long"), "vector-links")
    comp = components(found.select(F.col("h").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("label", F.col("h").alias("node")).agg(F.sum("links").alias("links"))
    named = classes.select("label", "h1", "h2", "node", "weight").join(links, ["label", "node"], "left").join(comp, "node", "left") \
        .select("label", "h1", "h2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    own = rows.select("id", "label", "h1", "h2", "ok")
    met = own.filter("ok").join(named, ["label", "h1", "h2"]).select("id", "n_links", "component_id")
    return met.unionByName(own.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


QUERIES = {"op3_vector_dedup": op3_vector_dedup}
ORACLES = {"op3_vector_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
n AS (SELECT a, count(*) AS c FROM link GROUP BY a),
m AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_links, CAST(least(vec_id, coalesce(m.c, vec_id)) AS BIGINT) AS component_id,
       vec_id = least(vec_id, coalesce(m.c, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""}
