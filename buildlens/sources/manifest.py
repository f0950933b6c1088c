"""The manifest as an append-only log, staged run folders, and recovery on resume.

Every change of an output folder is a version: a few rows are appended to
``manifest_log/version=<n>/``, and a last row of kind ``commit`` makes the version
count.  Row kinds: ``config`` (the run's configuration), ``run`` (a run's status),
``shard`` (a shard's samples, digests and run) and ``removal``.  What is live is the
highest committed version per shard, so no row grows with the shards and
nothing is rewritten.

A run writes to folders of its own, ``shards/run_id=<id>/`` and ``sidecar/run_id=<id>/``.
They are read through the log only, so a run that dies at any point changes
nothing that a reader sees.  One writer at a time is assumed.

A digest is the row count and two 64-bit sums of row hashes: it does not depend on
row order or on files, is folded in one partial aggregate, and tells a row
that was changed, lost or repeated.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import shard_name
from ..operators.resume import config_diff
from ..session import ensure_checkpoint_dir, listing_by_few_tasks
from . import shards as SH

LOG_SCHEMA = ("kind string, run_id string, shard_index int, shard_name string, num_samples long, vectors_digest string, "
              "text_digest string, status string, detail string, recorded_at string, version long")
VECTORS, TEXTS = "shards", "sidecar"
LINE_KEYS = "record_index int, sample_id string"
STORED = T.StructType([*SH.SHARD_SCHEMA.fields, T.StructField("run_id", T.StringType(), True)])
VECTOR_COLUMNS = ("message_embedding", "diff_embedding", "context_embedding")


class ManifestError(ValueError):
    """The manifest, or what it lists, is not what a run left."""


def now() -> str:
    return datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")


def _fs(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, path)
    return fs.exists(hpath)


def _kept(df: DataFrame) -> DataFrame:
    """A small table that several steps read: a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _remove(spark: SparkSession, path: str) -> None:
    fs, hpath = _fs(spark, path)
    if fs.exists(hpath):
        fs.delete(hpath, True)


# ------------------------------------------------------------------ the log
def _raw_log(spark: SparkSession, out_dir: str) -> DataFrame:
    if not exists(spark, f"{out_dir}/manifest_log"):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(f"{out_dir}/manifest_log")


def log_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Log rows from the driver: a handful of run, config or removal records."""
    names = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], LOG_SCHEMA)


def append_version(spark: SparkSession, out_dir: str, rows: DataFrame) -> int:
    """Append ``rows`` (without version) as the next version; it counts once its commit row is there."""
    last = _raw_log(spark, out_dir).agg(F.max("version")).first()[0]
    version = 0 if last is None else last + 1
    path = f"{out_dir}/manifest_log/version={version}"
    at = now()
    rows.drop("version").withColumn("recorded_at", F.coalesce("recorded_at", F.lit(at))).write.mode("append").parquet(path)
    log_rows(spark, [{"kind": "commit", "recorded_at": at}]).drop("version").coalesce(1).write.mode("append").parquet(path)
    return version


def read_log(spark: SparkSession, out_dir: str) -> DataFrame:
    """Rows of all committed versions."""
    log = _raw_log(spark, out_dir)
    return log.where("kind <> 'commit'").join(log.where("kind = 'commit'").select("version").distinct(), "version", "left_semi")


def snapshot(spark: SparkSession, out_dir: str) -> DataFrame:
    """The live shard entries: per shard the highest committed version, unless it is a removal."""
    rows = read_log(spark, out_dir).where("kind IN ('shard', 'removal')")
    cols = [c for c in rows.columns if c != "shard_index"]
    # within a version, which an overwrite may give both, the new shard stands after the removal
    last = rows.groupBy("shard_index").agg(F.max_by(F.struct(*cols), F.struct("version", (F.col("kind") == "shard").cast("int"))).alias("r"))
    return last.select("shard_index", "r.*").where("kind = 'shard'").drop("kind")


def runs(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row per run: its latest status and detail (a run that died keeps ``started``)."""
    r = read_log(spark, out_dir).where("kind = 'run'")
    return r.groupBy("run_id").agg(F.min("version").alias("first_version"), F.max_by("status", "version").alias("status"),
                                   F.max_by("detail", "version").alias("detail"))


def stored_config(spark: SparkSession, out_dir: str) -> dict | None:
    """The configuration that the output was begun with since it was last emptied (the latest recorded)."""
    row = read_log(spark, out_dir).where("kind = 'config'").orderBy(F.desc("version")).select("detail").limit(1).collect()
    return json.loads(row[0]["detail"]) if row else None


# ------------------------------------------------------------------ digests
def _digest(*cols: Column) -> Column:
    """Order-free digest of a group's rows; a hash skips nulls, so each column's null flag goes in too."""
    cols = [x for c in cols for x in (c.isNull(), c)]
    lanes = [F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")) for seed in (1, 2)]
    return F.concat_ws(":", F.count(F.lit(1)), *[lane.cast("string") for lane in lanes])


def table_fingerprint(df: DataFrame, cols: list[str]) -> dict:
    """Rows and digest of an input table (J6), one aggregate."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sha2(_digest(*[F.col(c) for c in cols]), 256).alias("d")).first()
    return {"rows": r["n"], "sha256": r["d"]}


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    with listing_by_few_tasks(spark):
        return spark.read.schema(STORED).option("pathGlobFilter", "*.parquet").parquet(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    with listing_by_few_tasks(spark):
        return spark.read.schema("value string, run_id string, shard_index int").option("pathGlobFilter", "*.gz").text(path)


def vector_digests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per shard: samples, digest, and the checks of G4 and E5."""
    sizes = [F.coalesce(F.size(c), F.lit(-1)) for c in VECTOR_COLUMNS]
    cols = [F.col(f.name) for f in SH.SHARD_SCHEMA.fields if f.name != "shard_index"]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), _digest(*cols).alias("vectors_now"), F.count_distinct("sample_id").alias("ids"),
        F.min("record_index").alias("low"), F.max("record_index").alias("high"), F.count_distinct("record_index").alias("places"),
        F.min(F.least(*sizes)).alias("least"), F.max(F.greatest(*sizes)).alias("most"))


def text_digests(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), _digest(F.col("value")).alias("text_now"))


# ------------------------------------------------------------------ a run's folders
def begin_run(spark: SparkSession, out_dir: str, run_id: str, config: dict) -> int:
    return append_version(spark, out_dir, log_rows(spark, [
        {"kind": "config", "run_id": run_id, "detail": json.dumps(config, sort_keys=True)},
        {"kind": "run", "run_id": run_id, "status": "started"}]))


def fail_run(spark: SparkSession, out_dir: str, run_id: str, detail: dict) -> int:
    return append_version(spark, out_dir, log_rows(spark, [{"kind": "run", "run_id": run_id, "status": "failed", "detail": json.dumps(detail)}]))


def stage_vectors(sharded: DataFrame, out_dir: str, run_id: str) -> None:
    """Write a run's vectors; the rows are checked as they pass, so a bad run ends before it is listed.

    Refused: missing required fields, missing keys, negative places, and vectors whose sizes differ (S9, G4, E5).
    """
    missing = [c for c in SH.REQUIRED_SHARD_FIELDS if c not in sharded.columns]
    if missing:
        raise SH.ShardValidationError(f"samples lack {', '.join(missing)}")
    seen = Observation()
    sizes = [F.coalesce(F.size(c), F.lit(-1)) for c in VECTOR_COLUMNS]
    checked = sharded.observe(
        seen, F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("sample_id").isNull() | F.col("shard_index").isNull() | F.col("record_index").isNull()).alias("no_key"),
        F.count_if(F.col("record_index") < 0).alias("bad_place"),
        F.min(F.least(*sizes)).alias("least"), F.max(F.greatest(*sizes)).alias("most"))
    SH.write_shards(checked, f"{out_dir}/{VECTORS}/run_id={run_id}")
    got = seen.get
    if got["n"] and (got["no_key"] or got["bad_place"] or got["least"] != got["most"] or got["least"] < 1):
        raise SH.ShardValidationError(f"samples of run {run_id} are not valid: {got}")


def stage_texts(records: DataFrame, out_dir: str, run_id: str) -> None:
    SH.write_sidecar(records, f"{out_dir}/{TEXTS}/run_id={run_id}")


def staged_vectors(spark: SparkSession, out_dir: str, run_id: str) -> DataFrame:
    return _vectors(spark, f"{out_dir}/{VECTORS}/run_id={run_id}")


def staged_entries(spark: SparkSession, out_dir: str, run_id: str) -> DataFrame:
    """The entries of what a run has staged, from what lies in its folders; raises if the two sides don't match."""
    vectors = vector_digests(staged_vectors(spark, out_dir, run_id), ["shard_index"])
    texts = text_digests(_lines(spark, f"{out_dir}/{TEXTS}/run_id={run_id}"), ["shard_index"])
    both = _kept(vectors.join(texts, "shard_index", "full_outer"))
    bad = both.where("n IS NULL OR lines IS NULL OR n <> lines OR ids <> n OR low <> 0 OR high <> n - 1 OR places <> n").limit(5).collect()
    if bad:
        raise SH.ShardValidationError(f"staged shards are not valid: {[r.asDict() for r in bad]}")
    return both.select(
        F.lit("shard").alias("kind"), F.lit(run_id).alias("run_id"), "shard_index", shard_name(F.col("shard_index")).alias("shard_name"),
        F.col("n").alias("num_samples"), F.col("vectors_now").alias("vectors_digest"), F.col("text_now").alias("text_digest"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("string").alias("recorded_at"))


def commit_run(spark: SparkSession, out_dir: str, run_id: str, detail: dict, nothing: bool = False) -> int:
    """List what a run has staged: from this version on its shards are there.  Ids that are live already are refused."""
    end = log_rows(spark, [{"kind": "run", "run_id": run_id, "status": "succeeded", "detail": json.dumps(detail)}]).drop("version")
    if nothing:
        return append_version(spark, out_dir, end)
    entries = staged_entries(spark, out_dir, run_id)
    live = live_vectors(spark, out_dir).select("sample_id")
    twice = SH.duplicate_ids(staged_vectors(spark, out_dir, run_id).select("sample_id"), live).limit(1).collect()
    if twice:
        raise SH.ShardValidationError(f"sample id {twice[0]['sample_id']} exists already")
    return append_version(spark, out_dir, entries.unionByName(end))


def empty_output(spark: SparkSession, out_dir: str, run_id: str) -> None:
    """S14 overwrite: the log first lists every live shard as removed, then the generated folders go; other files stay."""
    gone = snapshot(spark, out_dir).select(
        F.lit("removal").alias("kind"), F.lit(run_id).alias("run_id"), "shard_index", "shard_name", "num_samples", "vectors_digest",
        "text_digest", "status", "detail", F.lit(None).cast("string").alias("recorded_at"))
    append_version(spark, out_dir, gone)
    for name in (VECTORS, TEXTS, "failures", "repo_attempts"):
        _remove(spark, f"{out_dir}/{name}")


def _of_live_runs(spark: SparkSession, out_dir: str, rows: DataFrame) -> DataFrame:
    """Rows of live shards: whole run folders are pruned by their few names, then shards by a semi join."""
    live = snapshot(spark, out_dir)
    names = [r[0] for r in live.select("run_id").distinct().collect()]  # one name per run that still has a shard
    return rows.where(F.col("run_id").isin(names)).join(live.select("run_id", "shard_index"), ["run_id", "shard_index"], "left_semi")


def live_vectors(spark: SparkSession, out_dir: str) -> DataFrame:
    """The vectors and keys of all live shards."""
    if not exists(spark, f"{out_dir}/{VECTORS}"):
        return spark.createDataFrame([], STORED)
    return _of_live_runs(spark, out_dir, _vectors(spark, f"{out_dir}/{VECTORS}"))


def live_texts(spark: SparkSession, out_dir: str, fields: str) -> DataFrame:
    """Sidecar records of all live shards, parsed with the field list ``fields`` (DDL)."""
    schema = f"{fields}, run_id string, shard_index int"
    if not exists(spark, f"{out_dir}/{TEXTS}"):
        return spark.createDataFrame([], schema)
    with listing_by_few_tasks(spark):
        records = spark.read.schema(schema).option("pathGlobFilter", "*.gz").json(f"{out_dir}/{TEXTS}")
    return _of_live_runs(spark, out_dir, records)


# ------------------------------------------------------------------ recovery
def folder_listing(spark: SparkSession, out_dir: str) -> DataFrame:
    """Files of both datasets: kind (vectors, text, tmp), run_id, shard_index, path; contents aren't read."""
    out = spark.createDataFrame([], "kind string, run_id string, shard_index int, path string")
    for folder, kind in ((VECTORS, "vectors"), (TEXTS, "text")):
        if exists(spark, f"{out_dir}/{folder}"):
            files = SH.file_listing(spark, f"{out_dir}/{folder}")
            out = out.unionByName(files.select(
                F.when(F.col("path").endswith(".tmp"), "tmp").otherwise(kind).alias("kind"),
                F.regexp_extract("path", "run_id=([^/]+)", 1).alias("run_id"), "shard_index", "path"))
    return out


def checksum_report(spark: SparkSession, out_dir: str) -> DataFrame:
    """Per live shard, whether vectors and texts still have the digests that the log holds."""
    keys = ["run_id", "shard_index"]
    j = snapshot(spark, out_dir).join(vector_digests(live_vectors(spark, out_dir), keys), keys, "left") \
        .join(text_digests(live_lines(spark, out_dir), keys), keys, "left")
    return j.select(*keys, "num_samples", F.col("vectors_digest").eqNullSafe(F.col("vectors_now")).alias("vectors_ok"),
                    F.col("text_digest").eqNullSafe(F.col("text_now")).alias("text_ok"))


def recovery_report(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row per (run, shard) that is listed or lies in the folders, with what a resume does about it.

    ``keep``: listed, and both sides are what the run left.  ``missing``, ``tampered``, ``misaligned``: listed, and a
    side is gone, its digest differs, or a line's place and id aren't those of the vectors.  ``delete``: not listed
    and half there, or a temporary file.  ``refuse``: not listed, and both sides are there.
    """
    listing = folder_listing(spark, out_dir)
    found = listing.groupBy("run_id", "shard_index").agg(
        F.max((F.col("kind") == "vectors").cast("int")).alias("v"), F.max((F.col("kind") == "text").cast("int")).alias("t"))
    live = snapshot(spark, out_dir).select("run_id", "shard_index", "num_samples", "vectors_digest", "text_digest", F.lit(True).alias("listed"))
    keys = ["run_id", "shard_index"]
    rows = live_vectors(spark, out_dir)
    lines = live_lines(spark, out_dir)
    place = lines.select(*keys, "record_index", F.col("sample_id").alias("text_id"))
    apart = rows.select(*keys, "record_index", "sample_id").join(place, [*keys, "record_index"], "full_outer") \
        .groupBy(*keys).agg(F.count_if(~F.col("sample_id").eqNullSafe(F.col("text_id"))).alias("misaligned"))
    j = live.join(found, keys, "full_outer").join(vector_digests(rows, keys), keys, "left") \
        .join(text_digests(lines, keys), keys, "left").join(apart, keys, "left")
    has_v, has_t = F.coalesce(F.col("v"), F.lit(0)) == 1, F.coalesce(F.col("t"), F.lit(0)) == 1
    same = F.col("vectors_digest").eqNullSafe(F.col("vectors_now")) & F.col("text_digest").eqNullSafe(F.col("text_now"))
    action = F.when(F.col("listed") & ~(has_v & has_t), "missing").when(F.col("listed") & (F.col("misaligned") > 0), "misaligned") \
        .when(F.col("listed") & ~same, "tampered").when(F.col("listed"), "keep").when(has_v & has_t, "refuse").otherwise("delete")
    return j.select(*keys, F.coalesce("listed", F.lit(False)).alias("listed"), has_v.alias("has_vectors"), has_t.alias("has_text"),
                    "num_samples", F.coalesce("n", F.lit(0)).cast("long").alias("found_samples"), action.alias("action"))


def live_lines(spark: SparkSession, out_dir: str) -> DataFrame:
    """Sidecar lines of live shards as text, with their place and id."""
    if not exists(spark, f"{out_dir}/{TEXTS}"):
        return spark.createDataFrame([], f"value string, run_id string, shard_index int, {LINE_KEYS}")
    lines = _of_live_runs(spark, out_dir, _lines(spark, f"{out_dir}/{TEXTS}"))
    return lines.withColumn("k", F.from_json("value", LINE_KEYS)).select("value", "run_id", "shard_index", "k.*")


@dataclass
class Recovery:
    completed: DataFrame      # sample_id of all verified samples
    samples: int
    shards: int
    next_shard: int
    removed_runs: list[str]   # runs whose half-written folders went


def recover(spark: SparkSession, out_dir: str, config: dict) -> Recovery:
    """Verify an output folder and make it ready for a resume, or raise.

    The log must be there and list shards 0..n-1; the stored configuration must be this one; every listed shard must
    have both sides, its counts, digests and ids; ids must not repeat across shards.  Half-written folders that no
    version lists are deleted; a whole unlisted pair is not trusted.
    """
    if not exists(spark, f"{out_dir}/manifest_log"):
        raise FileNotFoundError(f"nothing to resume: {out_dir} has no manifest log")
    stored = stored_config(spark, out_dir)
    if stored is not None:
        diffs = config_diff(spark, stored, config).collect()  # a handful of settings
        if diffs:
            raise ValueError(f"configuration differs from the stored run: {[r.asDict() for r in diffs]}")
    live = _kept(snapshot(spark, out_dir))
    state = SH.validate_manifest(live).first()
    if state["n_entries"] and not state["valid"]:
        raise ManifestError(f"the manifest log lists no whole series of shards: {state.asDict()}")
    report = _kept(recovery_report(spark, out_dir))
    bad = report.where("action NOT IN ('keep', 'delete')").orderBy("shard_index").limit(5).collect()
    if bad:
        raise ManifestError(f"cannot resume: {[r.asDict() for r in bad]}")
    completed = live_vectors(spark, out_dir).select("sample_id")
    twice = completed.groupBy("sample_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ManifestError(f"sample id {twice[0]['sample_id']} is in more than one listed shard")
    halves = [r[0] for r in report.where("action = 'delete'").select("run_id").distinct().collect()]  # one name per broken run
    listed = {r[0] for r in live.select("run_id").distinct().collect()}
    for run_id in set(halves) - listed:
        for folder in (VECTORS, TEXTS):
            if run_id:
                _remove(spark, f"{out_dir}/{folder}/run_id={run_id}")
    for r in folder_listing(spark, out_dir).where("kind = 'tmp'").select("path").toLocalIterator():
        _remove(spark, r["path"])
    return Recovery(completed, int(state["total_samples"] or 0), int(state["n_entries"]),
                    (state["max_index"] if state["max_index"] is not None else -1) + 1, sorted(set(halves) - listed))
