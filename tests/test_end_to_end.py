"""End-to-end run, resume, streaming ingest, config diff and the driver contract."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from buildlens.operators.resume import config_diff
from buildlens.plans import fixtures as FX
from buildlens.plans.preprocess import PreprocessConfig, run
from buildlens.plans.q_builds import builds_git
from buildlens.sources import manifest as MF
from buildlens.sources import shards as SH
from tests.conftest import SF_SMALL


def test_run_and_resume(spark, tmp_out):
    """The first run lacks half of the commits; a resume with all of them adds the rest, and nothing twice."""
    cfg = PreprocessConfig(shard_size=7)
    b = builds_git(spark, SF_SMALL)
    commits, files = FX.commits(spark, SF_SMALL), FX.commit_files(spark, SF_SMALL)
    s1 = run(spark, b, commits.where(F.crc32("commit_sha") % 2 == 0), files, tmp_out, cfg).first()
    shards = MF.live_vectors(spark, tmp_out)
    n1 = shards.count()
    assert n1 == s1["successful_samples"] and n1 > 0
    assert all(r["valid"] for r in SH.shard_report(shards).collect())
    s2 = run(spark, b, commits, files, tmp_out, cfg, resume=True).first()
    after = MF.live_vectors(spark, tmp_out)
    assert s2["successful_samples"] > 0 and after.count() == n1 + s2["successful_samples"]
    assert after.groupBy("sample_id").count().where("count > 1").count() == 0
    assert after.select("shard_index").distinct().count() == after.agg(F.max("shard_index")).first()[0] + 1
    assert MF.snapshot(spark, tmp_out).agg(F.sum("num_samples")).first()[0] == after.count()
    assert MF.live_texts(spark, tmp_out, "sample_id string").count() == after.count()
    assert sorted(r["status"] for r in MF.runs(spark, tmp_out).collect()) == ["succeeded", "succeeded"]
    with pytest.raises(ValueError, match="configuration differs"):  # another build table
        run(spark, b.where("source_row_index < 700"), commits, files, tmp_out, cfg, resume=True)


def test_config_diff(spark):
    a = {"dataset": {"csv": "x"}, "preprocessing": {"shard": 5}, "embedding": {"model_name": "m", "device": "cpu"}}
    b = {"dataset": {"csv": "x"}, "preprocessing": {"shard": 6}, "embedding": {"model_name": "m", "device": "gpu"}}
    rows = config_diff(spark, a, b).collect()
    assert [(r["section"], r["key"]) for r in rows] == [("preprocessing", "shard")]


def test_driver_contract_small(spark):
    import __spark_entry__ as E
    assert E.entry(spark).count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    con = duckdb.connect()
    for t in ("orders", "documents", "embeddings", "labels", "pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    for name in ("repo_summary", "diff_provenance", "context_provenance", "repo_split", "incremental_ingest"):
        got = q[name](spark, SF_SMALL)
        exp = con.execute(o[name]).fetchall()
        assert got.count() == len(exp), name


def test_oracle_type_map_is_current():
    """Every column-type entry belongs to an oracle (an oracle without one casts its columns itself)."""
    from buildlens.plans.oracle_types import TYPES
    from buildlens.plans.registry import raw_oracles
    assert set(TYPES) <= set(raw_oracles())


def test_small_end_to_end_scenario(spark, tmp_out):
    """Five builds of one repo, one commit missing, one commit used twice: four samples,
    one failure, shards of 3 -> [3, 1], labels in source order."""
    from buildlens.plans.preprocess import assemble_samples
    from buildlens.sources.builds import normalize_builds
    raw = spark.createDataFrame([
        (0, "org/p", "a1", "passed", 11.0, None), (1, "org/p", "a2", "failed", 12.0, "a1"),
        (2, "org/p", "zz", "passed", 13.0, "a2"), (3, "org/p", "a1", "passed", 14.0, "zz"),
        (4, "org/p", "a3", "passed", None, "a1")],
        "source_row_index long, gh_project_name string, git_trigger_commit string, tr_status string, "
        "tr_build_id double, git_prev_built_commit string")
    commits = spark.createDataFrame([("org/p", c, f"msg {c}\\n") for c in ("a1", "a2", "a3")],
                                    "repo string, commit_sha string, message string")
    files = spark.createDataFrame([("org/p", c, 0, "f.py", "M\\tf.py", "@@ -1 +1 @@\\n-x\\n+y", "y\\n")
                                   for c in ("a1", "a2", "a3")],
                                  "repo string, commit_sha string, file_order int, path string, name_status string, "
                                  "diff_text string, content_after string")
    b = normalize_builds(raw)
    samples, failures = assemble_samples(b, commits, files, PreprocessConfig(shard_size=3))
    got = sorted((r["source_row_index"], r["label"], r["build_id"]) for r in samples.collect())
    assert got == [(0, 1, "11"), (1, 0, "12"), (3, 1, "14"), (4, 1, None)]
    f = failures.collect()
    assert len(f) == 1 and f[0]["commit_sha"] == "zz" and f[0]["error"] == "Could not fetch commit zz"
    run(spark, b, commits, files, tmp_out, PreprocessConfig(shard_size=3))
    sizes = sorted(r["n"] for r in MF.live_vectors(spark, tmp_out).groupBy("shard_index")
                   .agg(F.count("*").alias("n")).collect())
    assert sizes == [1, 3]


def test_run_guards_and_records(spark, tmp_out):
    import pytest
    cfg = PreprocessConfig(shard_size=7)
    b = builds_git(spark, SF_SMALL).where("source_row_index < 300")
    args = (spark, b, FX.commits(spark, SF_SMALL), FX.commit_files(spark, SF_SMALL), tmp_out)
    s = run(*args, cfg).first()
    assert s["status"] == "succeeded" and s["failed_samples"] == s["attempted_rows"] - s["successful_samples"]
    assert (s["samples_per_second"] is None) == (s["successful_samples"] == 0)
    with pytest.raises(SH.OutputExistsError):
        run(*args, cfg)
    with pytest.raises(ValueError, match="configuration differs"):
        run(*args, PreprocessConfig(shard_size=9), resume=True)
    again = run(*args, cfg, resume=True).first()
    assert again["successful_samples"] == 0 and again["resume_completed_samples_at_start"] == s["successful_samples"]
    att = spark.read.json(f"{tmp_out}/repo_attempts")
    assert att.where(F.col("run_id") == s["run_id"]).agg(F.sum("attempted")).first()[0] == s["attempted_rows"]
    assert spark.read.json(f"{tmp_out}/run_summary").count() == 2


def test_stream_restart_is_exactly_once(spark, tmp_out):
    from buildlens.operators.resume import split_by_commit_availability
    from buildlens.streaming.incremental import start_ingest
    raw = FX.builds_git_raw(spark, SF_SMALL)
    src, out, ckpt = f"{tmp_out}/in", f"{tmp_out}/out", f"{tmp_out}/ckpt"
    parts = raw.repartitionByRange(4, "source_row_index")
    parts.where("source_row_index < 700").write.parquet(src)
    start_ingest(spark, src, raw.schema, FX.commits(spark, SF_SMALL), out, ckpt).awaitTermination()
    first_files = spark.read.parquet(src).inputFiles()
    parts.where("source_row_index >= 700").write.mode("append").parquet(src)
    spark.read.parquet(sorted(first_files)[0]).write.mode("append").parquet(src)  # re-delivered drop
    start_ingest(spark, src, raw.schema, FX.commits(spark, SF_SMALL), out, ckpt).awaitTermination()
    got = spark.read.parquet(f"{out}/accepted")
    ok, _ = split_by_commit_availability(builds_git(spark, SF_SMALL), FX.commits(spark, SF_SMALL))
    assert got.groupBy("sample_id").count().where("count > 1").count() == 0
    assert sorted(r[0] for r in got.select("sample_id").collect()) == sorted(r[0] for r in ok.select("sample_id").collect())


def test_repo_groups_spread_hot_repo(spark):
    from buildlens.sources.builds import repo_groups
    rows = [(i, "hot" if i % 3 else f"r{i}", f"c{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "source_row_index long, repo string, commit_sha string")
    g = repo_groups(df, 8)
    per_part = g.rdd.mapPartitions(lambda it: [sum(1 for r in it if r["repo"] == "hot")]).collect()
    assert sum(1 for n in per_part if n > 0) > 1
    flat = [(r["repo"], r["source_row_index"]) for r in g.collect()]
    assert flat == sorted(flat)


def test_input_and_column_checks(spark, tmp_out):
    import pytest
    from buildlens.plans.preprocess import assemble_samples
    from buildlens.sources.builds import MissingColumnError, check_columns, normalize_builds, read_builds_csv, ColumnRoles
    with pytest.raises(FileNotFoundError):
        read_builds_csv(spark, f"{tmp_out}/absent.csv")
    no_commit = spark.createDataFrame([(0, "r", "passed")], "source_row_index long, gh_project_name string, tr_status string")
    with pytest.raises(MissingColumnError, match="gh_project_name"):
        normalize_builds(no_commit)
    minimal = spark.createDataFrame([(0, "r", "c", "passed")],
                                    "source_row_index long, gh_project_name string, git_trigger_commit string, tr_status string")
    warnings = check_columns(minimal, ColumnRoles())
    assert len(warnings) == 2 and all("not found" in w for w in warnings)
    row = normalize_builds(minimal).first()
    assert row["build_id"] is None and row["parent_commit_sha"] is None and row["label"] == 1
    with_null = spark.createDataFrame([(0, None, "c", "passed"), (1, "r", "c", "failed")],
                                      "source_row_index long, gh_project_name string, git_trigger_commit string, tr_status string")
    commits = spark.createDataFrame([("r", "c", "m")], "repo string, commit_sha string, message string")
    files = spark.createDataFrame([], "repo string, commit_sha string, file_order int, path string, name_status string, "
                                      "diff_text string, content_after string")
    samples, failures = assemble_samples(normalize_builds(with_null), commits, files, PreprocessConfig())
    assert [r["source_row_index"] for r in samples.collect()] == [1]
    assert [(r["stage"], r["source_row_index"]) for r in failures.collect()] == [("input_validation", 0)]
    s = samples.first()
    assert s["diff"]["text"] == "" and s["context"]["text"] == "" and s["message"]["text"] == "m"


def test_training_lifecycle_from_stored_shards(spark, tmp_out):
    from buildlens.operators import fusion as FU
    from buildlens.plans.training import load_samples, predict_fusion, train_forest
    b = builds_git(spark, SF_SMALL)
    run(spark, b.where("source_row_index < 300"), FX.commits(spark, SF_SMALL), FX.commit_files(spark, SF_SMALL), f"{tmp_out}/gaps",
        PreprocessConfig(shard_size=7))
    with pytest.raises(ValueError, match="no sidecar label"):  # builds without a status can't be trained on
        load_samples(spark, f"{tmp_out}/gaps")
    run(spark, b.where("label IS NOT NULL AND source_row_index < 500"), FX.commits(spark, SF_SMALL), FX.commit_files(spark, SF_SMALL), f"{tmp_out}/pre",
        PreprocessConfig(shard_size=7))
    loaded = load_samples(spark, f"{tmp_out}/pre", 30)
    assert loaded.count() == 30
    per_split = {r["split"]: r["n"] for r in train_forest(spark, f"{tmp_out}/pre", f"{tmp_out}/rf",
                                                           num_trees=5, max_depth=4).collect()}
    assert per_split.get("test", 0) > 0
    assert spark.read.option("header", True).csv(f"{tmp_out}/rf/test_results").count() == per_split["test"]
    dim = len(loaded.first()["message_embedding"])
    cfg = FU.FusionConfig(embedding_dim=dim, model_dim=8, attention_dim=4, classifier_hidden_dim=8)
    FU.save(spark, FU.init_params(cfg, 1), cfg, f"{tmp_out}/fusion")
    r = predict_fusion(spark, f"{tmp_out}/pre", f"{tmp_out}/fusion", f"{tmp_out}/pred", 25).first()
    assert r["n"] == 25 and 0.0 <= r["error"] <= 1.0
    from buildlens.plans.training import predict_forest, sweep_forest, train_fusion
    m = predict_forest(spark, f"{tmp_out}/pre", f"{tmp_out}/rf", f"{tmp_out}/rf_pred").first()
    first, again = (sorted(map(tuple, spark.read.option("header", True).csv(f"{tmp_out}/{d}/test_results").collect())) for d in ("rf", "rf_pred"))
    assert first == again and 0.0 <= m["accuracy"] <= 1.0
    history = train_fusion(spark, f"{tmp_out}/pre", f"{tmp_out}/fusion2", epochs=1).collect()
    assert [r["epoch"] for r in history] == [1]
    metrics = json.loads(spark.read.json(f"{tmp_out}/fusion2/config").first()["metrics"])
    confusion = spark.read.option("header", True).csv(f"{tmp_out}/fusion2/confusion").collect()
    assert sum(int(r["predicted_0"]) + int(r["predicted_1"]) for r in confusion) == metrics["test"] == per_split["test"]
    with pytest.raises(ValueError):
        sweep_forest(spark, f"{tmp_out}/pre", f"{tmp_out}/sweep", [])


def test_scoped_conf_restores_settings(spark):
    import pytest
    from buildlens.session import scoped_conf
    key_set, key_unset = "spark.sql.shuffle.partitions", "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key_set)
    spark.conf.unset(key_unset)
    default = spark.conf.get(key_unset)
    with pytest.raises(RuntimeError):
        with scoped_conf(spark, {key_set: 3, key_unset: 5000}):
            assert spark.conf.get(key_set) == "3" and spark.conf.get(key_unset) == "5000"
            raise RuntimeError("boom")
    assert spark.conf.get(key_set) == before and spark.conf.get(key_unset) == default


def test_stream_writes_shards_of_accepted_builds(spark, tmp_out):
    from buildlens.operators.resume import split_by_commit_availability
    from buildlens.streaming.incremental import start_ingest
    raw = FX.builds_git_raw(spark, SF_SMALL)
    src, out, ckpt = f"{tmp_out}/in", f"{tmp_out}/out", f"{tmp_out}/ckpt"
    some = raw.where("source_row_index < 300")
    some.repartitionByRange(2, "source_row_index").write.parquet(src)
    start_ingest(spark, src, raw.schema, FX.commits(spark, SF_SMALL), out, ckpt, max_files_per_trigger=1,
                 commit_files=FX.commit_files(spark, SF_SMALL), cfg=PreprocessConfig(shard_size=20)).awaitTermination()
    ok, _ = split_by_commit_availability(builds_git(spark, SF_SMALL).where("source_row_index < 300"), FX.commits(spark, SF_SMALL))
    stored = spark.read.parquet(f"{out}/shards")
    assert sorted(r[0] for r in stored.select("sample_id").collect()) == sorted(r[0] for r in ok.select("sample_id").collect())
    assert stored.select("batch_id").distinct().count() == 2
    assert stored.groupBy("shard_index").agg(F.count_distinct("batch_id").alias("n")).where("n > 1").count() == 0
    entries = spark.read.parquet(f"{out}/manifest_shards")
    assert sorted(r[0] for r in entries.select("shard_index").collect()) == list(range(entries.count()))
