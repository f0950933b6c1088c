"""Registered query: the end-to-end preprocessing chain on the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resume as R
from ..sources import shards as SH
from . import duck as D
from . import fixtures as FX
from .preprocess import PreprocessConfig, plan_samples, select_builds
from .q_builds import _W_BUILDS_GIT, builds_git
from .q_text import SEP_DIFF, SEP_FIELD, duck_kept

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


_KEPT = duck_kept(100000).replace("WITH cf AS", ", cf AS", 1)


@query("preprocess_samples", _W_BUILDS_GIT + _KEPT + f"""
, dt AS (SELECT repo, commit_sha, length(string_agg(path || {SEP_FIELD} || ret, {SEP_DIFF} ORDER BY file_order)) AS diff_chars
   FROM k GROUP BY ALL),
ok AS (SELECT b.* FROM builds b WHERE EXISTS (SELECT 1 FROM commits c WHERE c.repo = b.repo AND c.commit_sha = b.commit_sha)),
pos AS (SELECT ok.*, row_number() OVER (ORDER BY repo, source_row_index) - 1 AS pos FROM ok)
SELECT pos.sample_id, CAST(floor(pos.pos / 50) AS INTEGER) AS shard_index, CAST(pos.pos % 50 AS INTEGER) AS record_index,
 pos.label, coalesce(dt.diff_chars, 0) AS diff_chars, length({D.strip('c.message')}) AS message_chars
FROM pos JOIN commits c USING (repo, commit_sha) LEFT JOIN dt USING (repo, commit_sha)""")
def q_preprocess_samples(spark, sf_dir):
    """Builds -> commit check -> message/diff/context -> tokens -> embeddings -> shard slots."""
    cfg = PreprocessConfig(shard_size=50)
    commits = FX.commits(spark, sf_dir)
    ok, _, _ = select_builds(builds_git(spark, sf_dir), commits, cfg)
    sharded = plan_samples(ok, commits, FX.commit_files(spark, sf_dir), cfg)
    return sharded.select("sample_id", "shard_index", "record_index", "label",
                          F.col("diff.provenance.retained_char_count").alias("diff_chars"),
                          F.col("message.provenance.retained_char_count").alias("message_chars"))


@query("preprocess_failures", _W_BUILDS_GIT + """
SELECT 'sample_processing' AS stage, count(*) AS n FROM builds b
WHERE NOT EXISTS (SELECT 1 FROM commits c WHERE c.repo = b.repo AND c.commit_sha = b.commit_sha)""")
def q_preprocess_failures(spark, sf_dir):
    """F1 via the full chain: failure records per stage."""
    _, failures, _ = select_builds(builds_git(spark, sf_dir), FX.commits(spark, sf_dir), PreprocessConfig(shard_size=50))
    return failures.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("incremental_ingest", _W_BUILDS_GIT + """
SELECT b.sample_id, b.repo, b.commit_sha, b.label FROM builds b
WHERE EXISTS (SELECT 1 FROM commits c WHERE c.repo = b.repo AND c.commit_sha = b.commit_sha)
  AND b.source_row_index % 3 <> 0""")
def q_incremental_ingest(spark, sf_dir):
    """Build files arrive in four drops plus a re-delivered copy of the first drop; a
    stream (availableNow, one file per trigger) deduplicates by sample id in its state and
    anti-joins the ids stored before the stream."""
    from ..streaming.incremental import start_ingest
    raw = FX.builds_git_raw(spark, sf_dir)
    src = SH.scratch_dir(spark, "incoming")
    raw.repartitionByRange(4, "source_row_index").write.parquet(src)
    first = spark.read.parquet(src).inputFiles()
    spark.read.parquet(sorted(first)[0]).write.mode("append").parquet(src)
    out = SH.scratch_dir(spark, "ingest")
    done = builds_git(spark, sf_dir).where(F.col("source_row_index") % 3 == 0).select("sample_id")
    q = start_ingest(spark, src, raw.schema, FX.commits(spark, sf_dir), out, SH.scratch_dir(spark, "ingest_ckpt"),
                     completed=done, max_files_per_trigger=1)
    q.awaitTermination()
    return spark.read.parquet(f"{out}/accepted").select("sample_id", "repo", "commit_sha", "label")


@query("incremental_retry", _W_BUILDS_GIT + """
, w AS (SELECT builds.*, CAST(substring(commit_sha, 2) AS BIGINT) % 3 AS k, EXISTS (SELECT 1 FROM commits c WHERE c.repo = builds.repo AND c.commit_sha = builds.commit_sha) AS known
  FROM builds)
SELECT sample_id, 'accepted' AS status, CASE WHEN k = 2 THEN 6 ELSE 0 END AS arrived_hour FROM w WHERE known AND (k < 2 OR source_row_index % 2 = 0)
UNION ALL SELECT sample_id, 'failed', CAST(NULL AS INTEGER) FROM w WHERE NOT known OR k = 2""")
def q_incremental_retry(spark, sf_dir):
    """Builds arrive at hour 0; a third of the commits with them, a third at hour 1, a third at hour 5, after the
    expiry of two hours.  Half of the builds that failed by then are delivered again at hour 6 and go on."""
    from datetime import datetime, timedelta
    from ..streaming.pending import BUILD, start_matching
    at = lambda hour: F.lit(datetime(2024, 1, 1) + timedelta(hours=hour))
    k = F.substring("commit_sha", 2, 20).cast("long") % 3
    builds, commits = builds_git(spark, sf_dir), FX.commits(spark, sf_dir).select("repo", "commit_sha")
    known = commits.where(k == 2)
    tick = spark.createDataFrame([("-", "-")], "repo string, commit_sha string")
    drops = [(builds, 0, commits.where(k == 0), 0), (None, 0, commits.where(k == 1), 1), (None, 0, tick, 4), (None, 0, tick, 4.5),
             (None, 0, known, 5), (builds.where((k == 2) & (F.col("source_row_index") % 2 == 0)).join(known, ["repo", "commit_sha"], "left_semi"), 6, tick, 6)]
    src, out, ckpt = (SH.scratch_dir(spark, name) for name in ("arrivals", "waiting", "waiting_ckpt"))
    stream = lambda: spark.readStream.schema(f"{BUILD}, arrived_at timestamp, is_commit boolean").parquet(src)
    for some, hour, arrived, commit_hour in drops:  # the stream goes on from its checkpoint after every drop, whatever its files
        part = arrived.select("repo", "commit_sha", at(commit_hour).alias("arrived_at"), F.lit(True).alias("is_commit"))
        if some is not None:
            part = part.unionByName(some.withColumn("arrived_at", at(hour)).withColumn("is_commit", F.lit(False)), allowMissingColumns=True)
        else:
            part = part.unionByName(builds.limit(0).withColumn("arrived_at", at(0)).withColumn("is_commit", F.lit(False)), allowMissingColumns=True)
        part.write.mode("append").parquet(src)
        start_matching(spark, stream().where("NOT is_commit").drop("is_commit"), stream().where("is_commit"), out, ckpt,
                       expiry=timedelta(hours=2)).awaitTermination()
    ok = spark.read.parquet(f"{out}/accepted").select("sample_id", F.lit("accepted").alias("status"), F.hour("arrived_at").alias("arrived_hour"))
    return ok.unionByName(spark.read.parquet(f"{out}/failures").select("sample_id", F.lit("failed").alias("status"), F.lit(None).cast("int").alias("arrived_hour")))
