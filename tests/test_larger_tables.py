"""What a larger table must not change: tasks per listing, rows of one numpy pass, single-task drops."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from buildlens.functions.text import py_splitlines, py_splitlines_keepends, strip_line_end
from buildlens.operators import embed as EM
from buildlens.operators import fusion as FU
from buildlens.plans import q_endtoend as Q
from buildlens.sources import manifest as MF

from .conftest import SF_SMALL


def test_folders_of_many_shards_are_listed_by_few_tasks(spark, tmp_out):
    spark.range(120).select("id", F.col("id").cast("int").alias("shard_index")).write.partitionBy("shard_index").parquet(f"{tmp_out}/{MF.VECTORS}/run_id=a")
    sc = spark.sparkContext
    sc.setJobGroup("listing of shards", "listing of shards")
    files = MF.folder_listing(spark, tmp_out)
    seen = sc.statusTracker()
    stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup("listing of shards") for s in seen.getJobInfo(j).stageIds]
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(s.numTasks for s in stages) <= 4 * sc.defaultParallelism
    assert files.where("kind = 'vectors'").select("shard_index").distinct().count() == 120


def test_fusion_passes_are_bounded(spark):
    rnd = np.random.default_rng(0)
    frame = pd.DataFrame({"sample_id": [str(i) for i in range(2 * FU.BLOCK + 5)]} | {c: list(rnd.normal(size=(2 * FU.BLOCK + 5, 4))) for c in FU.MODALITIES})
    parts = list(FU._blocks(iter([frame, frame.iloc[:0], frame.iloc[:3]])))
    assert [len(p) for p in parts] == [FU.BLOCK, FU.BLOCK, 5, 3]
    cfg = FU.FusionConfig(4, 8, 4, 8)
    params = FU.init_params(cfg, 0)
    df = spark.createDataFrame([(r.sample_id, 1, *[x.tolist() for x in r[1:]]) for r in frame.itertuples(index=False)],
                               "sample_id string, label int, " + ", ".join(f"{c} array<double>" for c in FU.MODALITIES)).coalesce(1)
    got = {r["sample_id"]: r["logit"] for r in FU.score(df, params, cfg).collect()}
    want, _, _ = FU._forward(params, cfg, FU._inputs(frame), None)
    assert np.allclose([got[i] for i in frame["sample_id"]], want)


def test_retry_drops_are_written_by_all_tasks(spark, monkeypatch):
    frame = type(spark.range(1))
    to_one = []
    monkeypatch.setattr(frame, "coalesce", lambda self, n: to_one.append(n) or self)
    out = Q.q_incremental_retry(spark, SF_SMALL)
    states = {(r["status"], r["arrived_hour"]): r["n"] for r in out.groupBy("status", "arrived_hour").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert not to_one and set(states) == {("accepted", 0), ("accepted", 6), ("failed", None)}


def test_quoted_csv_is_read_by_few_tasks(spark, tmp_out):
    """A task for each 32 KB before, so that time went with their number; the byte ranges stay as small."""
    from buildlens.plans.q_builds import q_scan_builds_quoted_csv
    n = 30_000
    spark.range(n).selectExpr("id AS o_orderkey", "id % 100 AS o_custkey", "'F' AS o_orderstatus", "date'2024-01-01' AS o_orderdate") \
        .write.parquet(f"{tmp_out}/orders.parquet")
    sc = spark.sparkContext
    sc.setJobGroup("quoted-csv", "")
    got = q_scan_builds_quoted_csv(spark, tmp_out).collect()
    tracker = sc.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("quoted-csv") for s in tracker.getJobInfo(j).stageIds]
    most = max(i.numTasks for i in map(tracker.getStageInfo, stages) if i is not None)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert most <= 5 * sc.defaultParallelism
    odd = '\n"q", z\nend'
    parent = lambda i: None if i < 100 else f"c{i - 100}" + (odd if i % 7 == 3 else "")
    assert sorted((r["source_row_index"], r["commit_sha"], r["parent_commit_sha"]) for r in got) == [(i, f"c{i}", parent(i)) for i in range(n)]


def test_texts_are_split_once_and_not_per_line(spark):
    """Before, a text was split three times for its token counts, and once more for every line of a kept diff."""
    texts = ["", "\n", "a\r\n", "a\n\r", "x\x0by\x1cz w\x85", " a\tb　c\x1f", "é\r\r\n~", "a b c d e f g h ", None]
    c, df = F.col("t"), spark.createDataFrame([(t,) for t in texts], "t string")
    made = df.select("t", py_splitlines(c).alias("a"), py_splitlines_keepends(c).alias("b"), strip_line_end(c).alias("e"), EM.token_metadata(c, 6).alias("n"))
    vectors = [r["v"] for r in EM.with_hash_embedding(df, "t", "v", 16, 6).collect()]
    assert vectors == [[float(x) for x in v] for v in EM.HashingEmbedder(16, 6).embed(texts)]
    for r in made.collect():
        t = r["t"]
        assert (r["a"], r["b"], r["e"]) == ((None,) * 3 if t is None else (t.splitlines(), t.splitlines(keepends=True), t.rstrip("\r\n")))
        n = len((t or "").split()) + 2
        assert tuple(r["n"]) == (n, min(n, 6), n > 6)
    plan = lambda col: df.select(col.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(EM.token_metadata(c, 6)).count("split(") == 1
    assert plan(py_splitlines_keepends(c)).count("split(") == 0
    assert plan(py_splitlines(c)).count("split(") == 1
