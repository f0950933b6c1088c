"""Registered queries: tokens, embeddings, shards, sidecar, manifest (phase 4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import sample_id as sample_id_expr
from ..functions.normalize import shard_name
from ..operators import embed as EM
from ..operators import resume as R
from ..sources import shards as SH
from . import duck as D
from . import fixtures as FX
from .q_builds import _W_BUILDS, _W_BUILDS_GIT, builds, builds_git, completed_ids

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


WS = ("'[\\t\\n\\x0b\\x0c\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}"
      "\\x{202f}\\x{205f}\\x{3000}]+'")
DUCK_TOKENS = f"list_filter(regexp_split_to_array(coalesce(text, ''), {WS}), lambda x: x <> '')"


def samples(spark, sf_dir):
    """View 5 with a deterministic sample id."""
    s = FX.samples_fx(spark, sf_dir)
    return s.withColumn("sample_id", sample_id_expr(F.col("repo"), F.col("commit_sha"), F.lit(None).cast("string"),
                                                    F.col("global_index")))


_W_SAMPLES = FX.duck_with(sx=FX.DUCK_SAMPLES).rstrip("\n") + (
    ",\ns AS (SELECT *, " + D.sample_id("repo", "commit_sha", "NULL", "global_index") + " AS sample_id FROM sx)\n")


@query("token_counts", f"""
SELECT doc_id, len({DUCK_TOKENS}) + 2 AS token_count_before_truncation,
 least(len({DUCK_TOKENS}) + 2, 512) AS retained_token_count,
 len({DUCK_TOKENS}) + 2 > 512 AS was_tokenizer_truncated FROM documents""")
def q_token_counts(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents")
    return d.select("doc_id", EM.token_metadata(F.col("text")).alias("t")).select("doc_id", "t.*")


HASH_DIM = 16


@query("hash_embedding", f"""
WITH t AS (SELECT doc_id, {DUCK_TOKENS}[1:510] AS toks FROM documents),
h AS (SELECT doc_id, toks, list_transform(toks, lambda x: {{'b': CAST(CAST(('0x' || substring(md5(x), 1, 8)) AS BIGINT) % {HASH_DIM} AS INTEGER),
   's': 1.0 - 2.0 * (CAST(('0x' || substring(md5(x), 9, 1)) AS INTEGER) % 2)}}) AS hs FROM t)
SELECT doc_id, list_transform(range(0, {HASH_DIM}), lambda d: CAST(coalesce(list_sum(list_transform(list_filter(hs, lambda e: e.b = d),
   lambda e: e.s)), 0.0) / greatest(len(toks), 1) AS FLOAT)) AS embedding FROM h""")
def q_hash_embedding(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents").select("doc_id", "text")
    return EM.with_hash_embedding(d, "text", "embedding", HASH_DIM).select("doc_id", "embedding")


@query("hash_embedding_udf")
def q_hash_embedding_udf(spark, sf_dir):
    """E2 through the pluggable Arrow-batch embedder (equals ``hash_embedding``)."""
    d = FX.table(spark, sf_dir, "documents").select("doc_id", "text")
    return EM.embed_columns(d, {"embedding": "text"}, lambda: EM.HashingEmbedder(HASH_DIM)).select("doc_id", "embedding")


@query("mean_pool", """
WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
m AS (SELECT label, pos, round(avg(v), 6) AS m FROM e GROUP BY label, pos)
SELECT label, list(m ORDER BY pos) AS mean_vector FROM m GROUP BY label""")
def q_mean_pool(spark, sf_dir):
    return EM.mean_vectors(FX.table(spark, sf_dir, "embeddings"), "label", "embedding")


@query("half_round", """
WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
u AS (SELECT vec_id, i, x, CASE WHEN x = 0 THEN 1.0
        ELSE pow(2.0, greatest(floor(log2(abs(CAST(x AS DOUBLE)))), -14) - 10) END AS ulp FROM e),
r AS (SELECT vec_id, i, x / ulp AS q, ulp FROM u),
h AS (SELECT vec_id, i, CAST((CASE WHEN q - floor(q) > 0.5 THEN floor(q) + 1 WHEN q - floor(q) < 0.5 THEN floor(q)
        ELSE floor(q) + (abs(CAST(floor(q) AS BIGINT)) % 2) END) * ulp AS FLOAT) AS v FROM r)
SELECT vec_id, list(v ORDER BY i) AS embedding_half FROM h GROUP BY vec_id""")
def q_half_round(spark, sf_dir):
    """float16 storage rounding in an Arrow batch UDF.  The oracle rounds to the half-precision
    grid (10 fraction bits, subnormal below 2^-14) with ties to even."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def to_half(v: pd.Series) -> pd.Series:
        return pd.Series([EM.half_round(np.asarray(x, dtype=np.float32)) for x in v])
    e = FX.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", to_half("embedding").alias("embedding_half"))


@query("embedding_dims", FX.duck_with(s=FX.DUCK_SAMPLES) + """
SELECT count(DISTINCT len(message_embedding)) AS message_embedding_n_dims,
 count(DISTINCT len(diff_embedding)) AS diff_embedding_n_dims,
 count(DISTINCT len(context_embedding)) AS context_embedding_n_dims,
 max(len(message_embedding)) AS message_embedding_dim, max(len(diff_embedding)) AS diff_embedding_dim,
 max(len(context_embedding)) AS context_embedding_dim,
 count_if(greatest(len(message_embedding), len(diff_embedding), len(context_embedding))
   <> least(len(message_embedding), len(diff_embedding), len(context_embedding))) AS rows_with_unequal_dims FROM s""")
def q_embedding_dims(spark, sf_dir):
    s = FX.samples_fx(spark, sf_dir)
    out = EM.embedding_dimension_check(s, ["message_embedding", "diff_embedding", "context_embedding"])
    return out.select(*[F.col(c).cast("long").alias(c) if c.endswith("n_dims") else F.col(c) for c in out.columns])


@query("shard_assign", _W_BUILDS_GIT + """
, ok AS (SELECT b.* FROM builds b WHERE EXISTS (SELECT 1 FROM commits c WHERE c.repo = b.repo AND c.commit_sha = b.commit_sha)),
p AS (SELECT sample_id, row_number() OVER (ORDER BY repo, source_row_index) - 1 AS pos FROM ok)
SELECT sample_id, CAST(floor(pos / 50) AS INTEGER) AS shard_index, CAST(pos % 50 AS INTEGER) AS record_index FROM p""")
def q_shard_assign(spark, sf_dir):
    b, c = builds_git(spark, sf_dir), FX.commits(spark, sf_dir)
    ok, _ = R.split_by_commit_availability(b, c)
    return SH.assign_shards(ok, ["repo", "source_row_index"], 50).select("sample_id", "shard_index", "record_index")


def _shard_rows(spark, sf_dir):
    s = samples(spark, sf_dir)
    return s.select("shard_index", "record_index", "sample_id", "repo", "commit_sha",
                    F.lit(None).cast("string").alias("build_id"), F.col("label").cast("int").alias("label"),
                    "message_embedding", "diff_embedding", "context_embedding")


def _written(spark, sf_dir):
    path = SH.scratch_dir(spark, "shards")
    SH.write_shards(_shard_rows(spark, sf_dir), path)
    return path


@query("shard_write_roundtrip", _W_SAMPLES + """
SELECT CAST(shard_index AS INTEGER) AS shard_index, CAST(record_index AS INTEGER) AS record_index, sample_id, repo,
 CAST(label AS INTEGER) AS label, len(message_embedding) AS dim FROM s""")
def q_shard_write_roundtrip(spark, sf_dir):
    back = SH.read_shards(spark, _written(spark, sf_dir))
    return back.select("shard_index", "record_index", "sample_id", "repo", "label",
                       F.size("message_embedding").alias("dim"))


@query("shard_scan", _W_SAMPLES + """
SELECT CAST(shard_index AS INTEGER) AS shard_index, count(*) AS num_samples,
 round(sum(list_sum(message_embedding)), 3) AS message_sum FROM s GROUP BY shard_index""")
def q_shard_scan(spark, sf_dir):
    back = SH.read_shards(spark, _written(spark, sf_dir))
    return back.groupBy("shard_index").agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.round(F.sum(F.aggregate("message_embedding", F.lit(0.0), lambda a, x: a + x)), 3).alias("message_sum"))


@query("file_checksums")
def q_file_checksums(spark, sf_dir):
    """sha256 per written shard file (rows-only: file names carry task ids)."""
    return SH.file_checksums(spark, _written(spark, sf_dir), "*.parquet")


@query("sidecar_records", _W_SAMPLES + """
SELECT CAST(shard_index AS INTEGER) AS shard_index, CAST(record_index AS INTEGER) AS record_index, sample_id, repo,
 CAST(label AS INTEGER) AS label FROM s""")
def q_sidecar_records(spark, sf_dir):
    rows = _shard_rows(spark, sf_dir).select("shard_index", "record_index", "sample_id", "repo", "label")
    path = SH.scratch_dir(spark, "sidecar")
    SH.write_sidecar(rows, path)
    schema = T.StructType([T.StructField("record_index", T.IntegerType()), T.StructField("sample_id", T.StringType()),
                           T.StructField("repo", T.StringType()), T.StructField("label", T.IntegerType()),
                           T.StructField("shard_index", T.IntegerType())])
    return SH.read_sidecar(spark, path, schema).select("shard_index", "record_index", "sample_id", "repo", "label")


@query("sidecar_json", _W_SAMPLES + """
SELECT CAST(shard_index AS INTEGER) AS shard_index, CAST(record_index AS INTEGER) AS record_index,
 to_json({'record_index': CAST(record_index AS INTEGER), 'sample_id': sample_id, 'repo': repo,
          'label': CAST(label AS INTEGER)}) AS json FROM s""")
def q_sidecar_json(spark, sf_dir):
    rows = _shard_rows(spark, sf_dir).select("shard_index", "record_index", "sample_id", "repo", "label")
    return SH.sidecar_json(rows).select("shard_index", "record_index", F.col("json").cast("string").alias("json"))


@query("manifest_shards", FX.duck_with(s=FX.DUCK_SAMPLES) + """
SELECT CAST(shard_index AS INTEGER) AS shard_index, count(*) AS num_samples,
 'shard_' || lpad(CAST(shard_index AS VARCHAR), 5, '0') AS shard_name FROM s GROUP BY shard_index""")
def q_manifest_shards(spark, sf_dir):
    return SH.manifest_shards(_shard_rows(spark, sf_dir))


@query("manifest_validate", FX.duck_with(s=FX.DUCK_SAMPLES) + """
, m AS (SELECT CAST(shard_index AS INTEGER) AS shard_index, count(*) AS num_samples FROM s GROUP BY shard_index)
SELECT count(*) AS n_entries, count(DISTINCT shard_index) AS n_distinct, min(shard_index) AS min_index,
 max(shard_index) AS max_index, CAST(0 AS BIGINT) AS bad_names, count_if(num_samples <= 0) AS bad_counts,
 sum(num_samples) AS total_samples,
 count(DISTINCT shard_index) = count(*) AND min(shard_index) = 0 AND max(shard_index) = count(*) - 1 AS valid FROM m""")
def q_manifest_validate(spark, sf_dir):
    return SH.validate_manifest(SH.manifest_shards(_shard_rows(spark, sf_dir)))


@query("manifest_totals", _W_BUILDS_GIT + """
SELECT count(c.commit_sha) AS successful_samples, count(*) - count(c.commit_sha) AS failed_samples,
 CAST(ceil(count(c.commit_sha) / 50.0) AS BIGINT) AS shards
FROM builds b LEFT JOIN commits c ON c.repo = b.repo AND c.commit_sha = b.commit_sha""")
def q_manifest_totals(spark, sf_dir):
    b, c = builds_git(spark, sf_dir), FX.commits(spark, sf_dir)
    ok, failures = R.split_by_commit_availability(b, c)
    entries = SH.manifest_shards(SH.assign_shards(ok, ["repo", "source_row_index"], 50))
    return SH.manifest_totals(entries, failures).select(
        F.col("successful_samples").cast("long").alias("successful_samples"),
        F.col("failed_samples").cast("long").alias("failed_samples"), F.col("shards").cast("long").alias("shards"))


@query("shard_validate", _W_SAMPLES + """
SELECT CAST(shard_index AS INTEGER) AS shard_index, count(*) AS num_samples, count(DISTINCT sample_id) AS distinct_ids,
 CAST(min(record_index) AS INTEGER) AS min_record, CAST(max(record_index) AS INTEGER) AS max_record,
 count(DISTINCT record_index) AS distinct_records,
 count(*) >= 1 AND count(DISTINCT sample_id) = count(*) AND min(record_index) = 0 AND max(record_index) = count(*) - 1
   AND count(DISTINCT record_index) = count(*) AS valid FROM s GROUP BY shard_index""")
def q_shard_validate(spark, sf_dir):
    return SH.shard_report(_shard_rows(spark, sf_dir))


@query("duplicate_ids", _W_BUILDS + """
, done AS (SELECT sample_id FROM builds WHERE source_row_index % 3 = 0),
t AS (SELECT sample_id, 1 AS n, 0 AS o FROM builds UNION ALL SELECT sample_id, 0, 1 FROM done)
SELECT sample_id, sum(n) AS n_new, sum(o) AS n_committed FROM t GROUP BY sample_id
HAVING sum(n) >= 1 AND sum(n) + sum(o) > 1""")
def q_duplicate_ids(spark, sf_dir):
    b = builds(spark, sf_dir)
    return SH.duplicate_ids(b.select("sample_id"), completed_ids(b))


@query("sidecar_alignment", _W_SAMPLES + """
SELECT CAST(s.shard_index AS INTEGER) AS shard_index, CAST(s.record_index AS INTEGER) AS record_index,
 s.sample_id AS payload_id, CAST(NULL AS VARCHAR) AS sidecar_id FROM s WHERE s.label IS NULL""")
def q_sidecar_alignment(spark, sf_dir):
    rows = _shard_rows(spark, sf_dir)
    sidecar = rows.where(F.col("label").isNotNull())
    return SH.sidecar_alignment(rows, sidecar)


@query("label_repair", _W_SAMPLES + """
, n AS (SELECT shard_index, bool_or(label IS NULL) AS needs FROM s GROUP BY shard_index)
SELECT s.global_index, CASE WHEN s.label IS NULL THEN s.sidecar_label ELSE s.label END AS label_repaired,
 n.needs AND s.sidecar_label IS NULL AS label_error FROM s JOIN n USING (shard_index)""")
def q_label_repair(spark, sf_dir):
    return SH.repair_labels(FX.samples_fx(spark, sf_dir)).select("global_index", "label_repaired", "label_error")


def _listing(spark, sf_dir):
    """File names of the fixture shards: a vector file per shard, and a text file for
    shards whose labels are all present."""
    s = FX.samples_fx(spark, sf_dir)
    per = s.groupBy("shard_index").agg(F.bool_and(F.col("label").isNotNull()).alias("full"))
    name = shard_name(F.col("shard_index"))
    vec = per.select(F.concat(name, F.lit(".parquet")).alias("name"))
    txt = per.where("full").select(F.concat(name, F.lit(".jsonl.gz")).alias("name"))
    return SH.shard_listing_from_names(vec.unionByName(txt))


@query("unpaired_shards", FX.duck_with(s=FX.DUCK_SAMPLES) + """
SELECT CAST(shard_index AS INTEGER) AS shard_index, 'text' AS missing FROM s GROUP BY shard_index
HAVING NOT bool_and(label IS NOT NULL)""")
def q_unpaired_shards(spark, sf_dir):
    return SH.unpaired_shards(_listing(spark, sf_dir))


@query("orphan_shards", FX.duck_with(s=FX.DUCK_SAMPLES) + """
, per AS (SELECT CAST(shard_index AS INTEGER) AS shard_index, bool_and(label IS NOT NULL) AS is_full FROM s
   GROUP BY shard_index)
SELECT shard_index, CASE WHEN is_full THEN 2 ELSE 1 END AS n_kinds, CASE WHEN is_full THEN 'refuse' ELSE 'delete' END AS action
FROM per WHERE shard_index >= 3""")
def q_orphan_shards(spark, sf_dir):
    listing = _listing(spark, sf_dir)
    listed = FX.samples_fx(spark, sf_dir).select("shard_index").distinct().where("shard_index < 3")
    return SH.orphan_shards(listing, listed)


@query("missing_keys", _W_SAMPLES + """
SELECT global_index, CASE WHEN label IS NULL THEN ['build_id', 'label'] ELSE ['build_id'] END AS missing_keys FROM s""")
def q_missing_keys(spark, sf_dir):
    s = samples(spark, sf_dir)
    present = s.select("global_index", F.array_compact(F.array(
        *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in
          ["shard_index", "record_index", "sample_id", "repo", "commit_sha", "label", "message_embedding",
           "diff_embedding", "context_embedding"]])).alias("present_keys"))
    return SH.missing_keys(present).select("global_index", "missing_keys")

# The Arrow-UDF embedder computes the same vectors as the native expression.
ORACLES["hash_embedding_udf"] = ORACLES["hash_embedding"]


@query("shard_states", FX.duck_with(s=FX.DUCK_SAMPLES) + """
, per AS (SELECT CAST(shard_index AS INTEGER) AS shard_index, bool_and(label IS NOT NULL) AS is_full FROM s
   GROUP BY shard_index),
mx AS (SELECT max(shard_index) AS m FROM per)
SELECT shard_index, true AS has_vectors, is_full AS has_text, shard_index = (SELECT m FROM mx) AS has_tmp,
 CASE WHEN shard_index = (SELECT m FROM mx) THEN 'interrupted' WHEN NOT is_full THEN 'unpaired' ELSE 'complete' END
   AS state
FROM per""")
def q_shard_states(spark, sf_dir):
    """Per-shard diagnosis of a listing: vector files for every shard, text files for
    shards whose labels are complete, a leftover temp file in the last shard."""
    s = FX.samples_fx(spark, sf_dir)
    last = s.agg(F.max("shard_index").alias("m"))
    tmp = last.select(F.concat(shard_name(F.col("m")), F.lit(".parquet.tmp")).alias("name"))
    listing = _listing(spark, sf_dir).unionByName(SH.shard_listing_from_names(tmp))
    return SH.shard_states(listing)
