"""Derived input views built from the driver tables.

Each view exists twice: a Spark builder (``spark.sql`` over DataFrame
arguments) and DuckDB text used inside the oracle SQL.  The two texts give
equal rows; only the content-rewrite expression differs by dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- builds
_BUILDS_BODY = """
SELECT o_orderkey AS source_row_index,
 concat('cust/', cast(o_custkey AS string)) AS gh_project_name,
 concat('c', cast(o_orderkey AS string)) AS git_trigger_commit,
 CASE WHEN o_orderstatus = 'F' THEN ' Passed ' WHEN o_orderstatus = 'O' THEN 'failed'
      WHEN o_orderkey % 11 = 0 THEN '' ELSE 'started' END AS tr_status,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE cast(o_orderkey AS double) END AS tr_build_id,
 lag(concat('c', cast(o_orderkey AS string))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
   AS git_prev_built_commit
FROM {orders}
"""

# View 2's commit number: builds spread over the commit table's numbers and a tenth more that it doesn't hold.
_BUILDS_GIT_BODY = """
SELECT source_row_index, concat('repo', cast(g % 20 AS string)) AS gh_project_name, concat('c', cast(g AS string)) AS git_trigger_commit,
 tr_status, tr_build_id, git_prev_built_commit
FROM (SELECT b.*, b.source_row_index % cast(floor(n * 11 / 10) AS bigint) AS g FROM ({builds}) b,
 (SELECT cast(floor(max(doc_id) / 5) + 1 AS bigint) AS n FROM {documents}) m)
"""

_COMMITS_BODY = """
SELECT concat('repo', cast(cast(floor(doc_id / 5) AS bigint) % 20 AS string)) AS repo,
 concat('c', cast(cast(floor(doc_id / 5) AS bigint) AS string)) AS commit_sha,
 concat('  ', text, chr(10)) AS message
FROM {documents} WHERE doc_id % 5 = 0
"""

_COMMIT_FILES_BODY = """
WITH d AS (SELECT doc_id, lang, text, cast(floor(doc_id / 5) AS bigint) AS g,
  concat('src/', lang, '/F', cast(doc_id AS string), '.java') AS path FROM {documents})
SELECT concat('repo', cast(g % 20 AS string)) AS repo, concat('c', cast(g AS string)) AS commit_sha,
 cast(doc_id % 5 AS int) AS file_order, path,
 CASE doc_id % 5 WHEN 0 THEN concat('M', chr(9), path) WHEN 1 THEN concat('A', chr(9), path)
   WHEN 2 THEN concat('R100', chr(9), 'old/F', cast(doc_id AS string), '.java', chr(9), path)
   WHEN 3 THEN concat('D', chr(9), path) ELSE NULL END AS name_status,
 CASE WHEN doc_id % 17 = 0 OR g % 50 = 3 THEN ' ' ELSE concat('diff --git a/', path, ' b/', path, chr(10),
   '--- a/', path, chr(10), '+++ b/', path, chr(10),
   '@@ -', cast(doc_id % 9 + 1 AS string), ' +', cast(doc_id % 9 + 1 AS string), ',',
   cast(length(text) - length(replace(text, chr(10), '')) + 1 AS string), ' @@', chr(10), '-old line', chr(10),
   '+', replace(text, chr(10), concat(chr(10), '+')), chr(10),
   '@@ -150,2 +160 @@', chr(10), '-x', chr(10), '-y', chr(10), '+z', chr(10)) END AS diff_text,
 CASE WHEN doc_id % 5 = 3 THEN NULL ELSE __CONTENT__ END AS content_after
FROM d
"""

_CONTENT_SPARK = """array_join(transform(split(text, chr(10)), (x, i) -> CASE WHEN i % 7 = 1
  THEN concat('  public void f', cast(i AS string), '() {') WHEN i % 7 = 5 THEN '  }' ELSE x END), chr(10))"""
_CONTENT_DUCK = """array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 7 = 1
  THEN concat('  public void f', cast(i - 1 AS string), '() {') WHEN (i - 1) % 7 = 5 THEN '  }' ELSE x END), chr(10))"""

_SAMPLES_BODY = """
SELECT e.vec_id AS global_index, cast(floor(e.vec_id / 100) AS int) AS shard_index,
 cast(e.vec_id % 100 AS int) AS record_index,
 concat('repo', cast((e.vec_id * e.vec_id) % 23 AS string)) AS repo, concat('c', cast(e.vec_id AS string)) AS commit_sha,
 CASE WHEN e.vec_id % 13 = 0 THEN NULL ELSE e.label % 2 END AS label, CASE WHEN e.vec_id % 5 = 0 THEN 1 - e.label % 2 ELSE e.label % 2 END AS sidecar_label,
 e.embedding AS message_embedding, d.embedding AS diff_embedding, c.embedding AS context_embedding
FROM (SELECT vec_id, embedding, label, (SELECT count(*) FROM {embeddings}) AS n FROM {embeddings}) e
JOIN {embeddings} d ON d.vec_id = (e.vec_id + 1) % e.n
JOIN {embeddings} c ON c.vec_id = (e.vec_id + 2) % e.n
"""

_PREDICTIONS_BODY = "SELECT doc_id, quality AS label, toxic AS prediction FROM {labels}"


def builds_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View 1: one build row per order, 1,500 repos at sf0.01 (uneven sizes)."""
    return spark.sql(_BUILDS_BODY, orders=table(spark, sf_dir, "orders"))


def builds_git_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View 2: view 1 re-keyed onto the commit tables; one build in eleven names an unknown commit."""
    return spark.sql(_BUILDS_GIT_BODY.replace("({builds})", "{builds}"), builds=builds_raw(spark, sf_dir), documents=table(spark, sf_dir, "documents"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View 3: one commit message per group of five documents."""
    return spark.sql(_COMMITS_BODY, documents=table(spark, sf_dir, "documents"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View 4: five changed files per commit, one per document."""
    # spark.sql formats its text with the DataFrame arguments: literal braces are doubled.
    body = _COMMIT_FILES_BODY.replace("__CONTENT__", _CONTENT_SPARK.replace("{", "{{").replace("}", "}}"))
    return spark.sql(body, documents=table(spark, sf_dir, "documents"))


def samples_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View 5: stored samples with three vectors, labels with gaps, 100 per shard."""
    return spark.sql(_SAMPLES_BODY, embeddings=table(spark, sf_dir, "embeddings"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View 6: labels and predictions for the metric operators."""
    return spark.sql(_PREDICTIONS_BODY, labels=table(spark, sf_dir, "labels"))


# ---------------------------------------------------------------- DuckDB text
def _duck(body: str, **tables: str) -> str:
    text = body.replace("cast(", "CAST(").replace(" AS string)", " AS VARCHAR)")
    for name in tables:
        text = text.replace("{" + name + "}", tables[name])
    return text


DUCK_BUILDS_RAW = _duck(_BUILDS_BODY, orders="orders")
DUCK_BUILDS_GIT_RAW = _duck(_BUILDS_GIT_BODY, builds=DUCK_BUILDS_RAW, documents="documents")
DUCK_COMMITS = _duck(_COMMITS_BODY, documents="documents")
DUCK_COMMIT_FILES = _duck(_COMMIT_FILES_BODY.replace("__CONTENT__", _CONTENT_DUCK), documents="documents")
DUCK_SAMPLES = _duck(_SAMPLES_BODY, embeddings="embeddings")
DUCK_PREDICTIONS = _duck(_PREDICTIONS_BODY, labels="labels")


def duck_with(**views: str) -> str:
    """``WITH name AS (...), ...`` prefix for an oracle query."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in views.items()) + "\n"
