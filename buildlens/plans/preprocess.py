"""End-to-end preprocessing run: build rows -> model-ready shards.

    scan -> ids/labels (P1-P5) -> first repos (G2) -> resume anti-join (J1)
    -> commit availability (J3, failures F1) -> per-commit message / diff /
    context artifacts (T1-T19), token metadata (E1) and embeddings (E2);
    shard slots of the build keys (G3) -> join ->
    staged shards + sidecar (S6, S7) -> failures (S11) -> manifest version (S8)

Shuffles: one by commit inside each of the diff and context builders, one
narrow range sort of build keys for the global order, one join of the slots to
the per-commit artifacts (skewed commits are split by AQE) and one by shard for
each of the two sinks.  Texts are embedded once per commit.
"""

from __future__ import annotations

from collections.abc import Callable
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context as CX
from ..operators import diffs as DF
from ..operators import embed as EM
from ..operators import resume as R
from ..sources import manifest as MF
from ..sources import shards as SH
from ..sources.builds import ColumnRoles, first_repos

KEYS = DF.KEYS


@dataclass
class PreprocessConfig:
    shard_size: int = SH.DEFAULT_SHARD_SIZE
    max_repos: int | None = None
    max_diff_chars_per_file: int = DF.MAX_DIFF_CHARS_PER_FILE
    max_total_diff_chars: int = DF.MAX_TOTAL_DIFF_CHARS
    max_changed_lines_per_file: int = CX.MAX_CHANGED_LINES_PER_FILE
    max_context_chars_per_snippet: int = CX.MAX_CONTEXT_CHARS_PER_SNIPPET
    max_total_context_chars: int = CX.MAX_TOTAL_CONTEXT_CHARS
    max_length: int = EM.DEFAULT_MAX_LENGTH
    embedding_dim: int = 64
    # None: the built-in hashing embedder as native expressions (no Python workers).
    embedder_factory: Callable | None = None
    extra: dict = field(default_factory=dict)


def _artifact(text, provenance_cols: list, max_length: int):
    return F.struct(text.alias("text"), F.struct(*provenance_cols).alias("provenance"),
                    EM.token_metadata(text, max_length).alias("tokenization"))


def commit_artifacts(commits: DataFrame, commit_files: DataFrame, cfg: PreprocessConfig) -> DataFrame:
    """Message, diff and context artifacts per commit (commits without files get empty texts)."""
    msg = DF.message_artifact(commits)
    prepared = CX.prepare_commit_files(commit_files, cfg.max_diff_chars_per_file, cfg.max_changed_lines_per_file)
    diff = DF.diff_artifacts(commit_files, cfg.max_diff_chars_per_file, cfg.max_total_diff_chars, prepared=prepared)
    ctx = CX.context_artifacts(commit_files, cfg.max_changed_lines_per_file, cfg.max_context_chars_per_snippet,
                               cfg.max_total_context_chars, prepared=prepared)
    d = diff.select(*KEYS, F.struct(*[c for c in diff.columns if c not in KEYS]).alias("d"))
    c = ctx.select(*KEYS, F.struct(*[c for c in ctx.columns if c not in KEYS]).alias("c"))
    j = msg.join(d, KEYS, "left").join(c, KEYS, "left")
    dtext = F.coalesce(F.col("d.text"), F.lit(""))
    ctext = F.coalesce(F.col("c.text"), F.lit(""))
    return j.select(
        *KEYS,
        _artifact(F.col("message.text"), [F.col("message.provenance.*")], cfg.max_length).alias("message"),
        _artifact(dtext, [F.lit("diff").alias("source_type"),
                          F.coalesce("d.files_found", F.lit(0)).alias("files_found"),
                          F.coalesce("d.files_retained", F.lit(0)).alias("files_retained"),
                          F.coalesce("d.original_char_count", F.lit(0)).alias("original_char_count"),
                          F.length(dtext).alias("retained_char_count"),
                          F.coalesce("d.extraction_truncated", F.lit(False)).alias("extraction_truncated"),
                          F.col("d.retained_file_order").alias("retained_file_order"),
                          F.col("d.files").alias("files")], cfg.max_length).alias("diff"),
        _artifact(ctext, [F.lit("context").alias("source_type"),
                          F.coalesce("c.regions_retained", F.lit(0)).alias("regions_retained"),
                          F.coalesce("c.original_char_count", F.lit(0)).alias("original_char_count"),
                          F.length(ctext).alias("retained_char_count"),
                          F.coalesce("c.extraction_truncated", F.lit(False)).alias("extraction_truncated"),
                          F.col("c.regions").alias("regions")], cfg.max_length).alias("context"))


def select_builds(builds: DataFrame, commits: DataFrame, cfg: PreprocessConfig,
                  completed_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(usable builds, failure records, attempted builds); no text is touched.

    Attempted are the builds of the kept repos not completed before.  Unknown
    repos give one ``repo_processing`` record each (F2); missing commits give
    one record per row (J3/F1)."""
    b = first_repos(builds, cfg.max_repos)
    null_repo = b.where(F.col("repo").isNull() | F.col("commit_sha").isNull())
    b = b.where(F.col("repo").isNotNull() & F.col("commit_sha").isNotNull())
    if completed_ids is not None:
        b = R.drop_completed(b, completed_ids)
    known, repo_failed = R.split_by_repo_availability(b, commits)
    ok, failures = R.split_by_commit_availability(known, commits)
    failures = failures.unionByName(repo_failed) \
        .unionByName(R.row_failures(null_repo, "input_validation", "missing repo or commit"))
    return ok, failures, b.unionByName(null_repo)


def check_unique(df: DataFrame, keys: list[str], what: str) -> None:
    """Repeated keys would multiply samples or mix up files: name one and stop."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what} holds {twice[0].asDict()}; expected one row per {', '.join(keys)}")


def assemble_samples(builds: DataFrame, commits: DataFrame, commit_files: DataFrame, cfg: PreprocessConfig,
                     completed_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Samples (one row per usable build, with its artifacts) and failure records."""
    ok, failures, _ = select_builds(builds, commits, cfg, completed_ids)
    check_unique(commits, KEYS, "the commit table")
    check_unique(commit_files, [*KEYS, "file_order"], "the changed-file table")
    return ok.join(commit_artifacts(commits, commit_files, cfg), KEYS, "inner"), failures


def plan_samples(ok: DataFrame, commits: DataFrame, commit_files: DataFrame, cfg: PreprocessConfig,
                 first_shard: int = 0) -> DataFrame:
    """Embedded samples with their shard slots, from usable builds.

    Artifacts and vectors are made once per commit that has a build, and
    checkpointed at that size.  Slots are given to the narrow build rows alone;
    texts and vectors join them last and cross one shuffle.
    """
    check_unique(commits, KEYS, "the commit table")
    check_unique(commit_files, [*KEYS, "file_order"], "the changed-file table")
    used = DF.materialize(ok.select(*KEYS).distinct())
    art = commit_artifacts(commits.join(used, KEYS, "left_semi"), commit_files.join(used, KEYS, "left_semi"), cfg)
    art = DF.materialize(embed_samples(art, cfg))
    return SH.assign_shards(ok, ["repo", "source_row_index"], cfg.shard_size, first_shard).join(art, KEYS)


def embed_samples(samples: DataFrame, cfg: PreprocessConfig) -> DataFrame:
    """E2 for the three texts: native hashing expressions, or a pluggable Arrow UDF model."""
    cols = {"message_embedding": "message.text", "diff_embedding": "diff.text",
            "context_embedding": "context.text"}
    if cfg.embedder_factory is None:
        for out, src in cols.items():
            samples = EM.with_hash_embedding(samples.withColumn(f"_t_{out}", F.col(src)), f"_t_{out}", out,
                                             cfg.embedding_dim, cfg.max_length).drop(f"_t_{out}")
        return samples
    staged = samples.select("*", *[F.col(src).alias(f"_t_{out}") for out, src in cols.items()])
    staged = EM.embed_columns(staged, {out: f"_t_{out}" for out in cols}, cfg.embedder_factory)
    return staged.drop(*[f"_t_{out}" for out in cols])


#: What identifies a build table: another one can't continue a run.
INPUT_COLUMNS = ["source_row_index", "repo", "commit_sha", "parent_commit_sha", "build_id", "raw_status", "sample_id"]


def _config(builds: DataFrame, cfg: PreprocessConfig, dataset: dict | None) -> dict:
    """The run's configuration by section; ``dataset`` may name the source and its column roles."""
    embedding = (cfg.embedder_factory().metadata() if cfg.embedder_factory is not None else
                 EM.HashingEmbedder(cfg.embedding_dim, cfg.max_length).metadata())
    preprocessing = {k: v for k, v in asdict(cfg).items() if k not in ("embedder_factory", "extra")}
    own = {"source": "builds", "columns": asdict(ColumnRoles())} | (dataset or {})
    return {"dataset": own | MF.table_fingerprint(builds, [c for c in INPUT_COLUMNS if c in builds.columns]),
            "embedding": embedding, "preprocessing": preprocessing}


def run(spark: SparkSession, builds: DataFrame, commits: DataFrame, commit_files: DataFrame, out_dir: str,
        cfg: PreprocessConfig = PreprocessConfig(), resume: bool = False, overwrite: bool = False,
        dataset: dict | None = None) -> DataFrame:
    """Full run; returns the one-row run summary.

    Outputs under ``out_dir``: ``shards/`` and ``sidecar/`` (a folder per run, read through the log),
    ``failures/``, ``repo_attempts/``, ``run_summary/`` (appended) and ``manifest_log/`` (see ``sources.manifest``).
    Existing outputs are refused unless ``overwrite``, which first lists them as removed, or ``resume``, which
    verifies all that is listed, clears half-written folders and refuses another input or configuration (J6).
    """
    if resume and overwrite:
        raise ValueError("resume and overwrite cannot be combined")
    t0 = time.monotonic()
    started = MF.now()
    config = _config(builds, cfg, dataset)
    has_output = any(_exists(spark, f"{out_dir}/{name}") for name in ("manifest_log", MF.VECTORS, MF.TEXTS))
    if has_output and not (resume or overwrite):
        raise SH.OutputExistsError(f"outputs exist in {out_dir}; pass resume=True or overwrite=True")
    completed, first_shard, done_samples, done_shards = None, 0, 0, 0
    if resume:
        state = MF.recover(spark, out_dir, config)
        completed, first_shard, done_samples, done_shards = state.completed, state.next_shard, state.samples, state.shards
    run_record = {"run_id": uuid.uuid4().hex, "started_at": started, "resume": resume, "first_shard": first_shard}
    run_id = run_record["run_id"]
    if overwrite and has_output:
        MF.empty_output(spark, out_dir, run_id)
    MF.begin_run(spark, out_dir, run_id, config)
    try:
        ok, failures, attempted = select_builds(builds, commits, cfg, completed)
        failures, attempted = DF.materialize(failures), DF.materialize(attempted)  # four sinks read them
        sharded = plan_samples(ok, commits, commit_files, cfg, first_shard)
        MF.stage_vectors(sharded, out_dir, run_id)
        MF.stage_texts(SH.sidecar_records(sharded), out_dir, run_id)
        failures = failures.withColumn("run_id", F.lit(run_id))
        failures.write.mode("append").json(f"{out_dir}/failures")
        R.repo_attempts(attempted, failures).withColumn("run_id", F.lit(run_id)).write.mode("append").json(f"{out_dir}/repo_attempts")
        counts = R.run_summary(attempted, MF.staged_vectors(spark, out_dir, run_id), failures).first()
        run_record.update(status="succeeded", finished_at=MF.now())
        failed = failures.where(F.col("source_row_index").isNotNull()).count()
        MF.commit_run(spark, out_dir, run_id, run_record | {"attempted_rows": counts["attempted_rows"], "successful_samples": counts["successful_samples"],
                                                           "failed_samples": failed}, nothing=counts["successful_samples"] == 0)
        exc = None
    except Exception as e:  # noqa: BLE001 - recorded, then re-raised
        counts, exc = None, {"type": type(e).__name__, "message": str(e)}
        run_record.update(status="failed", finished_at=MF.now())
        MF.fail_run(spark, out_dir, run_id, run_record | {"exception": exc})
    elapsed = time.monotonic() - t0
    attempted_n = int(counts["attempted_rows"]) if counts else None
    ok_n = int(counts["successful_samples"]) if counts else None
    summary = {
        **run_record, "elapsed_seconds": elapsed, "attempted_rows": attempted_n, "successful_samples": ok_n,
        # every attempted row either became a sample or failed (rows of failed repos included)
        "failed_samples": (attempted_n - ok_n) if counts else None,
        "samples_per_second": (ok_n / elapsed) if ok_n else None,
        "seconds_per_sample": (elapsed / ok_n) if ok_n else None,
        "resume_completed_samples_at_start": done_samples, "resume_completed_shards_at_start": done_shards,
        "next_shard_index": first_shard, "exception_type": exc and exc["type"],
        "exception_message": exc and exc["message"]}
    out = spark.createDataFrame([summary], RUN_SUMMARY_SCHEMA)
    out.write.mode("append").json(f"{out_dir}/run_summary")
    if exc is not None:
        raise RuntimeError(f"run failed: {exc['type']}: {exc['message']}")
    return out


RUN_SUMMARY_SCHEMA = (
    "run_id string, started_at string, resume boolean, first_shard long, status string, finished_at string, "
    "elapsed_seconds double, attempted_rows long, successful_samples long, failed_samples long, "
    "samples_per_second double, seconds_per_sample double, resume_completed_samples_at_start long, "
    "resume_completed_shards_at_start long, next_shard_index long, exception_type string, exception_message string")


_exists = MF.exists
