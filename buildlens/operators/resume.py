"""Resume and failure routing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import normalize_optional, sample_id

FAILURE_SCHEMA = T.StructType([
    T.StructField("stage", T.StringType(), False),
    T.StructField("repo", T.StringType(), True),
    T.StructField("commit_sha", T.StringType(), True),
    T.StructField("source_row_index", T.LongType(), True),
    T.StructField("build_id", T.StringType(), True),
    T.StructField("parent_commit_sha", T.StringType(), True),
    T.StructField("sample_id", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
])
FAILURE_COLUMNS = [f.name for f in FAILURE_SCHEMA.fields]


def drop_completed(builds: DataFrame, completed_ids: DataFrame) -> DataFrame:
    """Rows whose ``sample_id`` is already in a committed shard leave the flow.

    A left-anti join: AQE broadcasts the id set when it is small and falls
    back to a sort-merge anti-join when it is not.
    """
    return builds.join(completed_ids.select("sample_id").distinct(), "sample_id", "left_anti")


def resume_accounting(builds: DataFrame, completed_ids: DataFrame) -> DataFrame:
    """Per repo, rows seen / already completed / remaining; whole repos skipped."""
    done = completed_ids.select("sample_id").distinct().withColumn("_done", F.lit(True))
    flagged = builds.join(done, "sample_id", "left")
    per_repo = flagged.groupBy("repo").agg(
        F.count(F.lit(1)).alias("rows_seen"),
        F.count_if(F.col("_done").isNotNull()).alias("rows_completed"))
    return per_repo.select(
        "repo", "rows_seen", "rows_completed",
        (F.col("rows_seen") - F.col("rows_completed")).alias("rows_remaining"),
        (F.col("rows_seen") == F.col("rows_completed")).alias("repo_skipped"))


def split_by_commit_availability(builds: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Builds with a known commit, and failure records for the rest."""
    keys = commits.select("repo", "commit_sha").distinct()
    ok = builds.join(keys, ["repo", "commit_sha"], "left_semi")
    missing = builds.join(keys, ["repo", "commit_sha"], "left_anti")
    failures = row_failures(missing, "sample_processing",
                            F.concat(F.lit("Could not fetch commit "), F.col("commit_sha")))
    return ok, failures


def row_failures(rows: DataFrame, stage: str, error) -> DataFrame:
    """failure records with the row identity carried along."""
    return rows.select(
        F.lit(stage).alias("stage"), "repo", "commit_sha",
        F.col("source_row_index").cast("long").alias("source_row_index"),
        "build_id", "parent_commit_sha", "sample_id",
        (error if not isinstance(error, str) else F.lit(error)).alias("error"))


def repo_failures(repos: DataFrame, error) -> DataFrame:
    """one record per failed repo, no row identity."""
    return repos.select(
        F.lit("repo_processing").alias("stage"), "repo",
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in FAILURE_SCHEMA.fields
          if f.name not in ("stage", "repo", "error")],
        (error if not isinstance(error, str) else F.lit(error)).alias("error"))


def failure_identity(rows: DataFrame, index_text: str = "row_index_text",
                     build_id_col: str = "build_id_raw", parent_col: str = "parent_raw") -> DataFrame:
    """identity of a failed row from raw values.

    The row index is ``try_cast`` (NULL when not an integer); build id and
    parent go through P1; the sample id is only given when the index is known.
    """
    types = dict((f.name, f.dataType) for f in rows.schema.fields)
    idx = F.col(index_text).cast("string").try_cast("long")
    bid = normalize_optional(F.col(build_id_col), types[build_id_col])
    out = rows.withColumn("_idx", idx).withColumn("_bid", bid)
    return out.select(
        F.col("repo"), F.col("commit_sha"),
        F.col("_idx").alias("source_row_index"),
        F.col("_bid").alias("build_id"),
        normalize_optional(F.col(parent_col), types[parent_col]).alias("parent_commit_sha"),
        F.when(F.col("_idx").isNotNull(),
               sample_id(F.col("repo"), F.col("commit_sha"), F.col("_bid"), F.col("_idx"))).alias("sample_id"))


def repo_attempts(attempted: DataFrame, failures: DataFrame) -> DataFrame:
    """Per repo attempted / successful / failed counts.

    Repo-level failures count all the repo's rows as failed (a deliberate fix).
    """
    fails = failures.groupBy("repo").agg(
        F.count_if(F.col("stage") != "repo_processing").alias("_row_failed"),
        F.max((F.col("stage") == "repo_processing").cast("int")).alias("_repo_failed"))
    att = attempted.groupBy("repo").agg(F.count(F.lit(1)).alias("attempted"))
    j = att.join(fails, "repo", "left")
    failed = F.when(F.coalesce(F.col("_repo_failed"), F.lit(0)) == 1, F.col("attempted")) \
        .otherwise(F.coalesce(F.col("_row_failed"), F.lit(0)))
    return j.select("repo", "attempted", (F.col("attempted") - failed).alias("successful"),
                    failed.alias("failed"))


def run_summary(attempted: DataFrame, successful: DataFrame, failures: DataFrame,
                skipped_completed: DataFrame | None = None) -> DataFrame:
    """One-row run summary with counts (timing fields are filled by the caller).

    The inputs are tagged and unioned so a single partial/final aggregate
    counts all of them.
    """
    def tag(df: DataFrame, kind: str, cond=None) -> DataFrame:
        flag = F.lit(1) if cond is None else cond.cast("int")
        return df.select(F.lit(kind).alias("_kind"), flag.alias("_one"))

    parts = [tag(attempted, "attempted"), tag(successful, "successful"),
             tag(failures, "failed", F.col("stage") != "repo_processing")]
    if skipped_completed is not None:
        parts.append(tag(skipped_completed, "skipped"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    aggs = [F.coalesce(F.sum(F.when(F.col("_kind") == "attempted", F.col("_one"))), F.lit(0)).alias("attempted_rows"),
            F.coalesce(F.sum(F.when(F.col("_kind") == "successful", F.col("_one"))), F.lit(0)).alias("successful_samples"),
            F.coalesce(F.sum(F.when(F.col("_kind") == "failed", F.col("_one"))), F.lit(0)).alias("failed_samples")]
    if skipped_completed is not None:
        aggs.append(F.coalesce(F.sum(F.when(F.col("_kind") == "skipped", F.col("_one"))), F.lit(0))
                    .alias("skipped_completed_rows"))
    out = u.agg(*aggs)
    return out.withColumn(
        "samples_per_second", F.lit(None).cast("double"))


# Embedding settings that must match for a resume (device may differ).
EMBEDDING_COMPAT_KEYS = ["model_name", "max_length", "pooling", "embedding_dim", "dtype"]


def config_diff(spark, stored: dict, current: dict) -> DataFrame:
    """Field-wise comparison of two run configurations.

    Both configs (sections ``dataset``, ``preprocessing``, ``embedding``) are
    flattened to (section, key, value) rows and full-outer joined; every row
    where the values differ (NULL-safe) is a mismatch.  Only the listed
    embedding fields take part.
    """
    def flat(cfg: dict) -> list[tuple[str, str, str]]:
        out = []
        for section in ("dataset", "preprocessing", "embedding"):
            for k, v in sorted((cfg.get(section) or {}).items()):
                if section == "embedding" and k not in EMBEDDING_COMPAT_KEYS:
                    continue
                out.append((section, k, None if v is None else json.dumps(v, sort_keys=True)))
        return out
    schema = "section string, key string, value string"
    a = spark.createDataFrame(flat(stored), schema).withColumnRenamed("value", "stored")
    b = spark.createDataFrame(flat(current), schema).withColumnRenamed("value", "current")
    j = a.join(b, ["section", "key"], "full_outer")
    return j.where(~F.col("stored").eqNullSafe(F.col("current")))


def split_by_repo_availability(builds: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F2 re-aimed: a repo unknown to the commit source fails as a whole (the clone step).

    Returns the builds of known repos and one failure record per unknown repo.
    The known-repo list has one row per repo; AQE decides how to join it.
    """
    repos = commits.select("repo").distinct()
    ok = builds.join(repos, "repo", "left_semi")
    missing = builds.join(repos, "repo", "left_anti").select("repo").distinct()
    return ok, repo_failures(missing, F.concat(F.lit("Could not clone repository "), F.col("repo")))
