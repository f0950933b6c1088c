"""Registered queries: build table, ids, labels, resume, failures (phases 0-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import resume as R
from ..operators.ordering import with_global_index
from ..sources.builds import first_repos, normalize_builds
from . import duck as D
from . import fixtures as FX

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_builds(FX.builds_raw(spark, sf_dir))


def builds_git(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_builds(FX.builds_git_raw(spark, sf_dir))


def completed_ids(b: DataFrame) -> DataFrame:
    """Fixture: the ids of every third row count as already stored."""
    return b.where(F.col("source_row_index") % 3 == 0).select("sample_id")


_W_BUILDS = FX.duck_with(b=FX.DUCK_BUILDS_RAW).rstrip("\n") + ",\nbuilds AS (" + D.builds_select("b") + ")\n"
_W_BUILDS_GIT = (FX.duck_with(b=FX.DUCK_BUILDS_GIT_RAW).rstrip("\n") + ",\nbuilds AS (" + D.builds_select("b")
                 + "),\ncommits AS (" + FX.DUCK_COMMITS + ")\n")


@query("scan_builds", _W_BUILDS + "SELECT * FROM builds")
def q_scan_builds(spark, sf_dir):
    return builds(spark, sf_dir)


@query("scan_builds_missing_cols", FX.duck_with(b=FX.DUCK_BUILDS_RAW) + """
SELECT b.source_row_index, b.gh_project_name AS repo, b.git_trigger_commit AS commit_sha,
 CAST(NULL AS VARCHAR) AS parent_commit_sha, CAST(NULL AS VARCHAR) AS build_id, CAST(NULL AS VARCHAR) AS raw_status,
 CAST(NULL AS INTEGER) AS label,
 """ + D.sample_id("b.gh_project_name", "b.git_trigger_commit", "NULL", "b.source_row_index") + """ AS sample_id
FROM b""")
def q_scan_builds_missing_cols(spark, sf_dir):
    raw = FX.builds_raw(spark, sf_dir).select("source_row_index", "gh_project_name", "git_trigger_commit")
    return normalize_builds(raw)


@query("normalize_optional", FX.duck_with(b=FX.DUCK_BUILDS_RAW) + f"""
SELECT source_row_index, {D.optional_double('tr_build_id')} AS build_id_text,
 {D.optional_text('git_prev_built_commit')} AS parent_text, {D.optional_text('tr_status')} AS status_text
FROM b""")
def q_normalize_optional(spark, sf_dir):
    b = FX.builds_raw(spark, sf_dir)
    t = dict((f.name, f.dataType) for f in b.schema.fields)
    return b.select("source_row_index",
                    N.normalize_optional(F.col("tr_build_id"), t["tr_build_id"]).alias("build_id_text"),
                    N.normalize_optional(F.col("git_prev_built_commit"), t["git_prev_built_commit"]).alias("parent_text"),
                    N.normalize_optional(F.col("tr_status"), t["tr_status"]).alias("status_text"))


@query("normalize_label", _W_BUILDS + "SELECT source_row_index, raw_status, label FROM builds")
def q_normalize_label(spark, sf_dir):
    return builds(spark, sf_dir).select("source_row_index", "raw_status", "label")


@query("sample_id", _W_BUILDS + "SELECT source_row_index, sample_id FROM builds")
def q_sample_id(spark, sf_dir):
    return builds(spark, sf_dir).select("source_row_index", "sample_id")


@query("labels_float", _W_BUILDS + "SELECT source_row_index, CAST(label AS FLOAT) AS label_float FROM builds")
def q_labels_float(spark, sf_dir):
    return builds(spark, sf_dir).select("source_row_index", N.labels_float(F.col("label")).alias("label_float"))


@query("source_row_index", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS source_row_index FROM orders""")
def q_source_row_index(spark, sf_dir):
    o = FX.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return with_global_index(o, ["o_orderdate", "o_orderkey"], name="source_row_index") \
        .select("o_orderkey", "source_row_index")


@query("label_counts", _W_BUILDS + "SELECT label, count(*) AS n_samples FROM builds GROUP BY label")
def q_label_counts(spark, sf_dir):
    return builds(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n_samples"))


@query("repo_counts", _W_BUILDS + "SELECT repo, count(*) AS n_samples FROM builds GROUP BY repo")
def q_repo_counts(spark, sf_dir):
    return builds(spark, sf_dir).groupBy("repo").agg(F.count(F.lit(1)).alias("n_samples"))


def repo_summary(b: DataFrame) -> DataFrame:
    """Flagship: samples, successes, failures, unlabeled per repo."""
    return b.groupBy("repo").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("label") == 1).alias("successes"),
        F.count_if(F.col("label") == 0).alias("failures"),
        F.count_if(F.col("label").isNull()).alias("unlabeled"))


@query("repo_summary", _W_BUILDS + """
SELECT repo, count(*) AS samples, count_if(label = 1) AS successes, count_if(label = 0) AS failures,
 count_if(label IS NULL) AS unlabeled FROM builds GROUP BY repo""")
def q_repo_summary(spark, sf_dir):
    return repo_summary(builds(spark, sf_dir))


@query("repo_order", _W_BUILDS + """
SELECT repo, source_row_index, row_number() OVER (ORDER BY repo, source_row_index) - 1 AS global_position
FROM builds""")
def q_repo_order(spark, sf_dir):
    b = builds(spark, sf_dir).select("repo", "source_row_index")
    return with_global_index(b, ["repo", "source_row_index"], name="global_position")


@query("max_repos", _W_BUILDS + """
SELECT source_row_index, repo FROM builds
WHERE repo IN (SELECT DISTINCT repo FROM builds ORDER BY repo LIMIT 10)""")
def q_max_repos(spark, sf_dir):
    return first_repos(builds(spark, sf_dir), 10).select("source_row_index", "repo")


@query("resume_antijoin", _W_BUILDS + """
SELECT source_row_index, sample_id FROM builds
WHERE sample_id NOT IN (SELECT sample_id FROM builds WHERE source_row_index % 3 = 0)""")
def q_resume_antijoin(spark, sf_dir):
    b = builds(spark, sf_dir)
    return R.drop_completed(b, completed_ids(b)).select("source_row_index", "sample_id")


@query("resume_accounting", _W_BUILDS + """
, done AS (SELECT DISTINCT sample_id FROM builds WHERE source_row_index % 3 = 0)
SELECT repo, count(*) AS rows_seen, count(d.sample_id) AS rows_completed,
 count(*) - count(d.sample_id) AS rows_remaining, count(*) = count(d.sample_id) AS repo_skipped
FROM builds b LEFT JOIN done d USING (sample_id) GROUP BY repo""")
def q_resume_accounting(spark, sf_dir):
    b = builds(spark, sf_dir)
    return R.resume_accounting(b, completed_ids(b))


def _git_parts(spark, sf_dir):
    b = builds_git(spark, sf_dir)
    c = FX.commits(spark, sf_dir)
    return b, c


@query("missing_commits", _W_BUILDS_GIT + """
SELECT 'sample_processing' AS stage, b.repo, b.commit_sha, b.source_row_index, b.build_id, b.parent_commit_sha,
 b.sample_id, 'Could not fetch commit ' || b.commit_sha AS error
FROM builds b WHERE NOT EXISTS (SELECT 1 FROM commits c WHERE c.repo = b.repo AND c.commit_sha = b.commit_sha)""")
def q_missing_commits(spark, sf_dir):
    b, c = _git_parts(spark, sf_dir)
    return R.split_by_commit_availability(b, c)[1]


@query("available_commits", _W_BUILDS_GIT + """
SELECT b.source_row_index, b.repo, b.commit_sha FROM builds b
WHERE EXISTS (SELECT 1 FROM commits c WHERE c.repo = b.repo AND c.commit_sha = b.commit_sha)""")
def q_available_commits(spark, sf_dir):
    b, c = _git_parts(spark, sf_dir)
    return R.split_by_commit_availability(b, c)[0].select("source_row_index", "repo", "commit_sha")


@query("repo_attempts", _W_BUILDS_GIT + """
SELECT b.repo, count(*) AS attempted, count(c.commit_sha) AS successful, count(*) - count(c.commit_sha) AS failed
FROM builds b LEFT JOIN commits c ON c.repo = b.repo AND c.commit_sha = b.commit_sha GROUP BY b.repo""")
def q_repo_attempts(spark, sf_dir):
    b, c = _git_parts(spark, sf_dir)
    _, failures = R.split_by_commit_availability(b, c)
    return R.repo_attempts(b, failures)


@query("run_summary", _W_BUILDS_GIT + """
SELECT count(*) AS attempted_rows, count(c.commit_sha) AS successful_samples,
 count(*) - count(c.commit_sha) AS failed_samples, CAST(NULL AS DOUBLE) AS samples_per_second
FROM builds b LEFT JOIN commits c ON c.repo = b.repo AND c.commit_sha = b.commit_sha""")
def q_run_summary(spark, sf_dir):
    b, c = _git_parts(spark, sf_dir)
    ok, failures = R.split_by_commit_availability(b, c)
    return R.run_summary(b, ok, failures)


@query("failure_identity", FX.duck_with(b=FX.DUCK_BUILDS_RAW) + f"""
, r AS (SELECT gh_project_name AS repo, git_trigger_commit AS commit_sha,
   CASE WHEN source_row_index % 13 = 0 THEN 'row-' || CAST(source_row_index AS VARCHAR)
        ELSE CAST(source_row_index AS VARCHAR) END AS row_index_text,
   tr_build_id AS build_id_raw, git_prev_built_commit AS parent_raw FROM b)
SELECT repo, commit_sha, TRY_CAST(row_index_text AS BIGINT) AS source_row_index,
 {D.optional_double('build_id_raw')} AS build_id, {D.optional_text('parent_raw')} AS parent_commit_sha,
 CASE WHEN TRY_CAST(row_index_text AS BIGINT) IS NOT NULL THEN
 {D.sample_id('repo', 'commit_sha', D.optional_double('build_id_raw'), 'TRY_CAST(row_index_text AS BIGINT)')}
 END AS sample_id
FROM r""")
def q_failure_identity(spark, sf_dir):
    raw = FX.builds_raw(spark, sf_dir)
    rows = raw.select(
        F.col("gh_project_name").alias("repo"), F.col("git_trigger_commit").alias("commit_sha"),
        F.when(F.col("source_row_index") % 13 == 0,
               F.concat(F.lit("row-"), F.col("source_row_index").cast("string")))
        .otherwise(F.col("source_row_index").cast("string")).alias("row_index_text"),
        F.col("tr_build_id").alias("build_id_raw"), F.col("git_prev_built_commit").alias("parent_raw"))
    return R.failure_identity(rows)


@query("scan_builds_csv", _W_BUILDS + "SELECT * REPLACE (nullif(raw_status, '') AS raw_status) FROM builds")
def q_scan_builds_csv(spark, sf_dir):
    """The build fixture as header CSV part files (range-partitioned, so path order
    then line order is source order), scanned with every column as text and NA tokens ->
    NULL; the row index comes from file order."""
    from ..sources.builds import read_builds_csv
    from ..sources.shards import scratch_dir
    path = scratch_dir(spark, "builds_csv")
    FX.builds_raw(spark, sf_dir).repartitionByRange(4, "source_row_index").sortWithinPartitions("source_row_index") \
        .drop("source_row_index").write.option("header", True).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    from ..sources.builds import normalize_builds_csv
    return normalize_builds_csv(read_builds_csv(spark, path))


@query("scan_builds_quoted_csv", _W_BUILDS + """
SELECT * REPLACE (nullif(raw_status, '') AS raw_status, CASE WHEN source_row_index % 7 = 3 THEN parent_commit_sha || chr(10) || '"q", z' || chr(10) || 'end'
  ELSE parent_commit_sha END AS parent_commit_sha) FROM builds""")
def q_scan_builds_quoted_csv(spark, sf_dir):
    """Quoted fields with line ends, quotes and commas, in files that are read as many byte ranges."""
    from ..session import scoped_conf
    from ..sources.builds import normalize_builds_csv, read_builds_csv
    from ..sources.shards import scratch_dir
    path = scratch_dir(spark, "quoted_csv")
    odd = F.concat("git_prev_built_commit", F.lit('\n"q", z\nend'))
    raw = FX.builds_raw(spark, sf_dir).withColumn("git_prev_built_commit", F.when(F.col("source_row_index") % 7 == 3, odd).otherwise(F.col("git_prev_built_commit")))
    raw.repartitionByRange(2, "source_row_index").sortWithinPartitions("source_row_index").drop("source_row_index").write \
        .options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    # byte ranges as small as ever, but a few tasks per core read them all
    with scoped_conf(spark, {"spark.sql.files.maxPartitionBytes": 1 << 15, "spark.sql.files.openCostInBytes": 0,
                             "spark.sql.files.maxPartitionNum": 4 * spark.sparkContext.defaultParallelism}):
        read = read_builds_csv(spark, path).checkpoint(eager=True)
    return normalize_builds_csv(read)


@query("portable_path", """
SELECT page_id, string_split(url, '/')[-1] AS file_name FROM pages""")
def q_portable_path(spark, sf_dir):
    return FX.table(spark, sf_dir, "pages").select("page_id", N.portable_path(F.col("url")).alias("file_name"))


@query("shard_name_codec", """
SELECT o_orderkey, 'shard_' || lpad(CAST(o_orderkey // 100 AS VARCHAR), 5, '0') AS shard_name,
 CAST(o_orderkey // 100 AS INTEGER) AS parsed_index,
 TRY_CAST(nullif(regexp_extract(o_orderpriority, '^shard_(\\d+)', 1), '') AS INTEGER) AS junk_parsed FROM orders""")
def q_shard_name_codec(spark, sf_dir):
    o = FX.table(spark, sf_dir, "orders")
    name = N.shard_name(F.floor(F.col("o_orderkey") / 100).cast("int"))
    return o.select("o_orderkey", name.alias("shard_name"), N.shard_index_of(name).alias("parsed_index"),
                    N.shard_index_of(F.col("o_orderpriority")).alias("junk_parsed"))


@query("iso_utc", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
 CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END
 || 'Z' AS ts_iso FROM events""")
def q_iso_utc(spark, sf_dir):
    return FX.table(spark, sf_dir, "events").select("event_id", N.iso_utc(F.col("ts")).alias("ts_iso"))


@query("repo_failures", _W_BUILDS + """
, cm AS (SELECT DISTINCT repo FROM (""" + FX.DUCK_COMMITS + """))
SELECT 'repo_processing' AS stage, repo, CAST(NULL AS VARCHAR) AS commit_sha, CAST(NULL AS BIGINT) AS source_row_index,
 CAST(NULL AS VARCHAR) AS build_id, CAST(NULL AS VARCHAR) AS parent_commit_sha, CAST(NULL AS VARCHAR) AS sample_id,
 'Could not clone repository ' || repo AS error
FROM (SELECT DISTINCT repo FROM builds) b WHERE repo NOT IN (SELECT repo FROM cm)""")
def q_repo_failures(spark, sf_dir):
    """view-1 builds against the commit source: every unknown repo is one failure record."""
    return R.split_by_repo_availability(builds(spark, sf_dir), FX.commits(spark, sf_dir))[1]


@query("failure_log", _W_BUILDS_GIT + """
SELECT 'sample_processing' AS stage, b.repo, b.commit_sha, b.source_row_index, b.build_id, b.parent_commit_sha,
 b.sample_id, 'Could not fetch commit ' || b.commit_sha AS error
FROM builds b WHERE NOT EXISTS (SELECT 1 FROM commits c WHERE c.repo = b.repo AND c.commit_sha = b.commit_sha)""")
def q_failure_log(spark, sf_dir):
    """Failure records appended as JSON lines in two writes, read back with a fixed schema."""
    from ..sources.shards import scratch_dir
    b, c = _git_parts(spark, sf_dir)
    _, failures = R.split_by_commit_availability(b, c)
    path = scratch_dir(spark, "failures")
    failures.where("source_row_index % 2 = 0").write.mode("append").json(path)
    failures.where("source_row_index % 2 = 1").write.mode("append").json(path)
    return spark.read.schema(R.FAILURE_SCHEMA).json(path)
