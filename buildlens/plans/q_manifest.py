"""Registered queries: manifest log, recovery, checksums, output states and configurations of folders that the engine wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resume as R
from ..sources import manifest as MF
from ..sources import shards as SH
from . import fixtures as FX
from .preprocess import INPUT_COLUMNS
from .q_builds import _W_BUILDS, builds
from .q_shards import _W_SAMPLES, samples

QUERIES: dict = {}
ORACLES: dict = {}
SIZE = 20  # samples per shard


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _slots(spark, sf_dir, size: int = SIZE):
    """Samples of view 5 in shards of ``size``, as ``write_shards`` and ``sidecar_records`` take them."""
    s = samples(spark, sf_dir)
    return s.withColumn("shard_index", F.floor(F.col("global_index") / size).cast("int")) \
        .withColumn("record_index", (F.col("global_index") % size).cast("int")) \
        .withColumn("source_row_index", F.col("global_index")) \
        .withColumn("build_id", F.lit(None).cast("string")).withColumn("parent_commit_sha", F.lit(None).cast("string")) \
        .withColumn("label", F.col("label").cast("int"))


def _stage(rows, out: str, run_id: str) -> None:
    MF.stage_vectors(rows, out, run_id)
    MF.stage_texts(SH.sidecar_records(rows), out, run_id)


def _run(spark, rows, out: str, run_id: str) -> None:
    MF.begin_run(spark, out, run_id, {})
    _stage(rows, out, run_id)
    MF.commit_run(spark, out, run_id, {})


def _flip_labels(spark, out: str, run_id: str, shard: int) -> None:
    """Tamper: rewrite one shard's vectors with other labels."""
    path = f"{out}/{MF.VECTORS}/run_id={run_id}/shard_index={shard}"
    rows = spark.read.parquet(path).withColumn("label", F.coalesce(F.lit(1) - F.col("label"), F.lit(1))).checkpoint(eager=True)
    rows.write.mode("overwrite").parquet(path)


def _change_lines(spark, out: str, run_id: str, shard: int, keep, change=None) -> None:
    """Tamper: rewrite one shard's sidecar with some lines only, or changed."""
    path = f"{out}/{MF.TEXTS}/run_id={run_id}/shard_index={shard}"
    lines = spark.read.text(path).where(keep).checkpoint(eager=True)
    if change is not None:
        lines = lines.withColumn("value", change)
    lines.coalesce(1).write.mode("overwrite").option("compression", "gzip").text(path)


def _touch(spark, path: str) -> None:
    fs, hpath = MF._fs(spark, path)
    out = fs.create(hpath)
    out.write(1)
    out.close()


_W_SLOTS = _W_SAMPLES.rstrip("\n") + f""",
sh AS (SELECT CAST(floor(global_index / {SIZE}) AS INTEGER) AS shard_index, count(*) AS num_samples FROM s GROUP BY ALL),
n AS (SELECT max(shard_index) + 1 AS n FROM sh)
"""


@query("resume_recovery", _W_SLOTS + """
SELECT CASE WHEN shard_index < n - 2 THEN 'a' WHEN shard_index = n - 2 THEN 'b' ELSE 'c' END AS run_id, shard_index,
 shard_index < n - 2 AS listed, true AS has_vectors, shard_index <> 2 AND shard_index <> n - 2 AS has_text,
 CASE WHEN shard_index < n - 2 THEN num_samples END AS num_samples,
 CASE WHEN shard_index < n - 2 THEN num_samples ELSE 0 END AS found_samples,
 CASE WHEN shard_index = n - 2 THEN 'delete' WHEN shard_index = n - 1 THEN 'refuse' WHEN shard_index = 0 THEN 'tampered'
   WHEN shard_index = 1 THEN 'misaligned' WHEN shard_index = 2 THEN 'missing' ELSE 'keep' END AS action
FROM sh, n""")
def q_resume_recovery(spark, sf_dir):
    """A folder after: a run whose first shard was changed since, whose second has ids in other places and whose third lost
    its texts; a run that died between vectors and texts; and a run that wrote both and was never listed."""
    out = SH.scratch_dir(spark, "recovery")
    rows = _slots(spark, sf_dir)
    n = rows.agg(F.max("shard_index")).first()[0] + 1
    _run(spark, rows.where(F.col("shard_index") < n - 2), out, "a")
    _flip_labels(spark, out, "a", 0)
    place = F.get_json_object("value", "$.record_index")
    _change_lines(spark, out, "a", 1, F.lit(True), F.regexp_replace("value", F.lit('"record_index":[0-9]+'), F.concat(
        F.lit('"record_index":'), ((place.cast("int") + 1) % SIZE).cast("string"))))
    MF._remove(spark, f"{out}/{MF.TEXTS}/run_id=a/shard_index=2")
    MF.begin_run(spark, out, "b", {})
    MF.stage_vectors(rows.where(F.col("shard_index") == n - 2), out, "b")
    MF.begin_run(spark, out, "c", {})
    _stage(rows.where(F.col("shard_index") == n - 1), out, "c")
    return MF.recovery_report(spark, out)


@query("manifest_log", _W_SLOTS + """,
half AS (SELECT n // 2 AS h FROM n),
big AS (SELECT CAST(floor(global_index / 50) AS INTEGER) AS shard_index, count(*) AS num_samples FROM s GROUP BY ALL)
SELECT CAST(v AS BIGINT) AS version, kind, run_id, CAST(shard_index AS INTEGER) AS shard_index, CAST(num_samples AS BIGINT) AS num_samples, status FROM (
SELECT * FROM (VALUES (0, 'config', 'a', NULL, NULL, NULL), (0, 'run', 'a', NULL, NULL, 'started'), (1, 'run', 'a', NULL, NULL, 'succeeded'),
  (2, 'config', 'b', NULL, NULL, NULL), (2, 'run', 'b', NULL, NULL, 'started'), (3, 'run', 'b', NULL, NULL, 'failed'),
  (4, 'config', 'c', NULL, NULL, NULL), (4, 'run', 'c', NULL, NULL, 'started'), (5, 'run', 'c', NULL, NULL, 'succeeded'),
  (7, 'config', 'd', NULL, NULL, NULL), (7, 'run', 'd', NULL, NULL, 'started'), (8, 'run', 'd', NULL, NULL, 'succeeded'))
  AS t(v, kind, run_id, shard_index, num_samples, status)
UNION ALL SELECT 1, 'shard', 'a', shard_index, num_samples, NULL FROM sh, half WHERE shard_index < h
UNION ALL SELECT 5, 'shard', 'c', shard_index, num_samples, NULL FROM sh, half WHERE shard_index >= h
UNION ALL SELECT 6, 'removal', 'd', shard_index, num_samples, NULL FROM sh
UNION ALL SELECT 8, 'shard', 'd', shard_index, num_samples, NULL FROM big
UNION ALL SELECT 8, 'live', 'd', shard_index, num_samples, NULL FROM big)""")
def q_manifest_log(spark, sf_dir):
    """The log of one folder after a run, a run that failed after its vectors, a resume and an overwrite with
    larger shards; rows of kind ``live`` are the snapshot at the end."""
    out = SH.scratch_dir(spark, "log")
    rows = _slots(spark, sf_dir)
    half = (rows.agg(F.max("shard_index")).first()[0] + 1) // 2
    _run(spark, rows.where(F.col("shard_index") < half), out, "a")
    rest = rows.where(F.col("shard_index") >= half)
    MF.begin_run(spark, out, "b", {})
    MF.stage_vectors(rest, out, "b")
    MF.fail_run(spark, out, "b", {"exception": "stopped"})
    state = MF.recover(spark, out, {})
    if state.removed_runs != ["b"] or state.next_shard != half:
        raise MF.ManifestError(f"unexpected recovery: {state}")
    _run(spark, R.drop_completed(rows, state.completed), out, "c")
    MF.empty_output(spark, out, "d")
    _run(spark, _slots(spark, sf_dir, 50), out, "d")
    cols = ["version", "kind", "run_id", "shard_index", "num_samples", "status"]
    return MF.read_log(spark, out).select(*cols).unionByName(MF.snapshot(spark, out).withColumn("kind", F.lit("live")).select(*cols))


@query("checksum_verify", _W_SLOTS + """
SELECT 'a' AS run_id, shard_index, num_samples, shard_index <> 0 AS vectors_ok, shard_index <> 1 AND shard_index <> 2 AS text_ok FROM sh""")
def q_checksum_verify(spark, sf_dir):
    """Digests of a written folder after one shard's labels changed, a line of the second was lost and the third's texts went."""
    out = SH.scratch_dir(spark, "checksums")
    _run(spark, _slots(spark, sf_dir), out, "a")
    _flip_labels(spark, out, "a", 0)
    _change_lines(spark, out, "a", 1, F.get_json_object("value", "$.record_index") != "0")
    MF._remove(spark, f"{out}/{MF.TEXTS}/run_id=a/shard_index=2")
    return MF.checksum_report(spark, out)


@query("output_state", _W_SLOTS + """
SELECT step, state, CASE step WHEN 0 THEN 0 WHEN 1 THEN n - 1 WHEN 2 THEN n - 1 ELSE n END AS shards FROM n,
 (VALUES (0, 'empty'), (1, 'complete'), (2, 'manifest_present'), (3, 'unpaired'), (4, 'interrupted')) AS t(step, state)""")
def q_output_state(spark, sf_dir):
    """S15 of one folder as it grows: nothing; a staged run; listed; one shard without texts; a temporary file."""
    out = SH.scratch_dir(spark, "states")
    rows = _slots(spark, sf_dir)
    n = rows.agg(F.max("shard_index")).first()[0] + 1
    seen = []

    def note(listed: bool):
        files = MF.folder_listing(spark, out)
        seen.append((len(seen), SH.output_state(files, listed), files.where("kind = 'vectors'").select("shard_index").distinct().count()))

    note(False)
    _stage(rows.where(F.col("shard_index") < n - 1), out, "a")
    note(False)
    MF.commit_run(spark, out, "a", {})
    note(True)
    MF.stage_vectors(rows.where(F.col("shard_index") == n - 1), out, "b")
    note(True)
    _touch(spark, f"{out}/{MF.VECTORS}/run_id=b/shard_index={n - 1}/part.parquet.tmp")
    note(True)
    return spark.createDataFrame(seen, "step int, state string, shards int")


@query("config_diff", _W_BUILDS + """
, c AS (SELECT count(*) AS n, count_if(source_row_index % 97 <> 0) AS m FROM builds)
SELECT 'dataset' AS section, 'rows' AS key, CAST(n AS VARCHAR) AS stored, CAST(m AS VARCHAR) AS current FROM c
UNION ALL SELECT 'dataset', 'sha256', 'a digest', 'a digest'
UNION ALL SELECT 'preprocessing', 'shard_size', '50', '60'""")
def q_config_diff(spark, sf_dir):
    """A stored configuration against one of a shorter build table and other shards; the device doesn't count."""
    b = builds(spark, sf_dir)
    cols = [c for c in INPUT_COLUMNS if c in b.columns]

    def config(rows, size, device):
        return {"dataset": {"source": "builds"} | MF.table_fingerprint(rows, cols), "preprocessing": {"shard_size": size},
                "embedding": {"model_name": "hash", "device": device}}

    out = SH.scratch_dir(spark, "config")
    MF.begin_run(spark, out, "a", config(b, 50, "cpu"))
    found = R.config_diff(spark, MF.stored_config(spark, out), config(b.where("source_row_index % 97 <> 0"), 60, "gpu"))
    hide = lambda c: F.when(F.col("key") == "sha256", F.when(F.length(c) == 66, "a digest")).otherwise(F.col(c)).alias(c)
    return found.select("section", "key", hide("stored"), hide("current"))
