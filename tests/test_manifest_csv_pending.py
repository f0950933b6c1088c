"""Manifest log and recovery, CSV records across splits, builds that wait for commits."""

import csv
import io
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from buildlens.plans import fixtures as FX
from buildlens.plans.preprocess import PreprocessConfig, run
from buildlens.plans.q_builds import builds_git
from buildlens.session import scoped_conf
from buildlens.sources import manifest as MF
from buildlens.sources import shards as SH
from buildlens.sources.builds import read_builds_csv
from buildlens.sources.csv_records import UnbalancedQuotesError
from tests.conftest import SF_SMALL

# ------------------------------------------------------------------ manifest


def rows(spark, n, first=0, size=4, dim=2):
    """n samples in shards of ``size``."""
    vec = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (F.col("id") * i).cast("float"))
    return spark.range(first, first + n).select(
        F.floor(F.col("id") / size).cast("int").alias("shard_index"), (F.col("id") % size).cast("int").alias("record_index"),
        F.concat(F.lit("s"), "id").alias("sample_id"), F.col("id").alias("source_row_index"), F.lit("r").alias("repo"),
        F.concat(F.lit("c"), "id").alias("commit_sha"), F.lit(None).cast("string").alias("parent_commit_sha"),
        F.lit(None).cast("string").alias("build_id"), (F.col("id") % 2).cast("int").alias("label"),
        vec.alias("message_embedding"), vec.alias("diff_embedding"), vec.alias("context_embedding"))


def listed(spark, out, data, run_id, config=None):
    MF.begin_run(spark, out, run_id, config or {})
    MF.stage_vectors(data, out, run_id)
    MF.stage_texts(SH.sidecar_records(data), out, run_id)
    MF.commit_run(spark, out, run_id, {})


def test_a_run_is_seen_only_when_listed(spark, tmp_out):
    out = f"{tmp_out}/o"
    listed(spark, out, rows(spark, 10), "a")
    more = rows(spark, 8, first=12)
    MF.begin_run(spark, out, "b", {})
    MF.stage_vectors(more, out, "b")
    MF.stage_texts(SH.sidecar_records(more), out, "b")
    assert MF.live_vectors(spark, out).count() == 10 and MF.live_texts(spark, out, "sample_id string").count() == 10
    MF.commit_run(spark, out, "b", {})
    assert MF.live_vectors(spark, out).count() == 18 and MF.snapshot(spark, out).count() == 5
    assert {r["run_id"]: r["status"] for r in MF.runs(spark, out).collect()} == {"a": "succeeded", "b": "succeeded"}


def test_a_version_without_commit_row_does_not_count(spark, tmp_out):
    out = f"{tmp_out}/o"
    listed(spark, out, rows(spark, 4), "a")
    fake = MF.read_log(spark, out).where("kind = 'shard'").withColumn("kind", F.lit("removal")).drop("version").checkpoint()
    fake.write.parquet(f"{out}/manifest_log/version=7")  # a writer that died before its commit row
    assert MF.snapshot(spark, out).count() == 1
    assert MF.append_version(spark, out, fake) == 8
    assert MF.snapshot(spark, out).count() == 0


@pytest.mark.parametrize("spoil, error", [
    (lambda d: d.drop("label"), "lack label"),
    (lambda d: d.withColumn("sample_id", F.when(F.col("source_row_index") != 3, F.col("sample_id"))), "not valid"),
    (lambda d: d.withColumn("diff_embedding", F.when(F.col("source_row_index") == 3, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("diff_embedding"))), "not valid"),
    (lambda d: d.withColumn("record_index", F.col("record_index") + 1), "staged shards"),
    (lambda d: d.unionByName(d.limit(1)), "staged shards")])
def test_bad_runs_are_refused_before_they_are_listed(spark, tmp_out, spoil, error):
    out = f"{tmp_out}/o"
    with pytest.raises(SH.ShardValidationError, match=error):
        listed(spark, out, spoil(rows(spark, 10)), "a")
    assert MF.snapshot(spark, out).count() == 0


def test_ids_that_are_live_are_refused(spark, tmp_out):
    out = f"{tmp_out}/o"
    listed(spark, out, rows(spark, 8), "a")
    again = rows(spark, 4, first=8).withColumn("sample_id", F.when(F.col("source_row_index") == 9, "s2").otherwise(F.col("sample_id")))
    with pytest.raises(SH.ShardValidationError, match="s2 exists"):
        listed(spark, out, again, "b")


def test_recovery_clears_halves_and_refuses_the_rest(spark, tmp_out):
    out = f"{tmp_out}/o"
    config = {"dataset": {"sha256": "x"}, "preprocessing": {"size": 4}}
    with pytest.raises(FileNotFoundError):
        MF.recover(spark, out, config)
    listed(spark, out, rows(spark, 12), "a", config)
    MF.begin_run(spark, out, "b", config)
    MF.stage_vectors(rows(spark, 4, first=12), out, "b")  # died before its texts
    fs, hpath = MF._fs(spark, f"{out}/sidecar/run_id=a/shard_index=1/x.gz.tmp")
    half = fs.create(hpath)
    half.write(1)
    half.close()
    assert {(r["run_id"], r["action"]) for r in MF.recovery_report(spark, out).collect()} == {("a", "keep"), ("b", "delete")}
    state = MF.recover(spark, out, config)
    assert (state.samples, state.shards, state.next_shard, state.removed_runs) == (12, 3, 3, ["b"])
    assert not MF.exists(spark, f"{out}/shards/run_id=b") and not fs.exists(hpath)
    assert sorted(r[0] for r in state.completed.collect()) == sorted(f"s{i}" for i in range(12))
    with pytest.raises(ValueError, match="configuration differs"):
        MF.recover(spark, out, {"dataset": {"sha256": "y"}, "preprocessing": {"size": 4}})
    # both sides there, but never listed
    MF.stage_vectors(rows(spark, 4, first=12), out, "c")
    MF.stage_texts(SH.sidecar_records(rows(spark, 4, first=12)), out, "c")
    with pytest.raises(MF.ManifestError, match="refuse"):
        MF.recover(spark, out, config)


@pytest.mark.parametrize("what, error", [("line", "misaligned"), ("label", "tampered")])
def test_recovery_refuses_changed_outputs(spark, tmp_out, what, error):
    out = f"{tmp_out}/o"
    listed(spark, out, rows(spark, 12), "a")
    path = f"{out}/sidecar/run_id=a/shard_index=0"
    lines = spark.read.text(path).checkpoint()
    lines = lines.where("value NOT LIKE '%\"s1\"%'") if what == "line" else lines.withColumn("value", F.replace("value", F.lit('"label":1'), F.lit('"label":0')))
    lines.coalesce(1).write.mode("overwrite").option("compression", "gzip").text(path)
    with pytest.raises(MF.ManifestError, match=error):
        MF.recover(spark, out, {})


def test_overwrite_lists_removals_first_and_keeps_other_files(spark, tmp_out):
    cfg = PreprocessConfig(shard_size=7)
    args = (spark, builds_git(spark, SF_SMALL).where("source_row_index < 300"), FX.commits(spark, SF_SMALL), FX.commit_files(spark, SF_SMALL), tmp_out)
    first = run(*args, cfg).first()
    with open(f"{tmp_out}/notes.txt", "w") as fh:
        fh.write("mine")
    again = run(*args, PreprocessConfig(shard_size=5), overwrite=True).first()
    assert again["successful_samples"] == first["successful_samples"] == MF.live_vectors(spark, tmp_out).count()
    assert open(f"{tmp_out}/notes.txt").read() == "mine"
    log = {r["kind"]: r["v"] for r in MF.read_log(spark, tmp_out).groupBy("kind").agg(F.max("version").alias("v")).collect()}
    assert log["removal"] < log["config"] < log["shard"]
    assert MF.live_vectors(spark, tmp_out).select("run_id").distinct().collect()[0][0] == again["run_id"]


def test_a_failed_run_is_recorded_and_resumed(spark, tmp_out):
    class Broken:
        def metadata(self):
            return {"model_name": "broken"}

        def embed(self, texts):
            raise RuntimeError("no model")

    b, commits, files = builds_git(spark, SF_SMALL).where("source_row_index < 300"), FX.commits(spark, SF_SMALL), FX.commit_files(spark, SF_SMALL)
    with pytest.raises(RuntimeError, match="run failed"):
        run(spark, b, commits, files, tmp_out, PreprocessConfig(shard_size=7, embedder_factory=Broken))
    assert [r["status"] for r in MF.runs(spark, tmp_out).collect()] == ["failed"]
    with pytest.raises(ValueError, match="configuration differs"):
        run(spark, b, commits, files, tmp_out, PreprocessConfig(shard_size=7), resume=True)


# ------------------------------------------------------------------ CSV records

ODD_FIELDS = ["plain", "", 'say "hi"', "two\nlines", "\n", "a,b", ' lead', '""', "x\r\ny", 'q"\n"q', "é\n😀", "long " * 40]


@pytest.mark.parametrize("split", [150, 1 << 20])
def test_csv_records_across_splits_equal_the_csv_module(spark, tmp_out, split):
    rnd, want = random.Random(split), []
    for f in range(3):
        text = io.StringIO()
        out = csv.writer(text, lineterminator="\r\n" if f == 1 else "\n")
        out.writerow(["id", "one", "two"])
        for i in range(60):
            row = [f"{f}-{i}", rnd.choice(ODD_FIELDS), rnd.choice(ODD_FIELDS)]
            out.writerow(row)
            want.append([c or None for c in row])
            if i % 20 == 7:
                text.write("\n")  # blank lines aren't records
        with open(f"{tmp_out}/part-{f}.csv", "w", newline="") as fh:
            fh.write(text.getvalue()[:-1] if f == 2 else text.getvalue())  # the last line may have no end
    with scoped_conf(spark, {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": 0}):
        got = read_builds_csv(spark, tmp_out).orderBy("source_row_index").collect()
    assert [r["source_row_index"] for r in got] == list(range(len(want)))
    assert [[r["id"], r["one"], r["two"]] for r in got] == want


def test_csv_with_an_open_quote_is_refused(spark, tmp_out):
    with open(f"{tmp_out}/x.csv", "w") as fh:
        fh.write('a,b\n1,"open\n2,3\n')
    with pytest.raises(UnbalancedQuotesError):
        read_builds_csv(spark, tmp_out)


def test_csv_of_a_header_alone_and_a_quoted_record_over_many_splits(spark, tmp_out):
    with open(f"{tmp_out}/a.csv", "w") as fh:
        fh.write("a,b\n")
    with open(f"{tmp_out}/b.csv", "w") as fh:
        fh.write('a,b\n1,"' + "line\n" * 500 + '"\n2,y\n')
    with scoped_conf(spark, {"spark.sql.files.maxPartitionBytes": 100, "spark.sql.files.openCostInBytes": 0}):
        got = read_builds_csv(spark, tmp_out).orderBy("source_row_index").collect()
    assert [(r["source_row_index"], r["a"], r["b"]) for r in got] == [(0, "1", "line\n" * 500), (1, "2", "y")]


# ------------------------------------------------------------------ builds that wait

T0 = datetime(2024, 1, 1)


def test_builds_wait_for_their_commits(spark, tmp_out):
    """Known at once; later; too late (fails, then goes on when delivered again); never."""
    from buildlens.streaming.pending import start_matching
    kind = "source_row_index long, repo string, commit_sha string, parent_commit_sha string, build_id string, raw_status string, label int, sample_id string, arrived_at timestamp"

    def build(i, commit, hour):
        return (i, "r", commit, None, None, "passed", 1, f"s{i}", T0 + timedelta(hours=hour))

    drops = [([build(0, "now", 0), build(1, "later", 0), build(2, "late", 0), build(3, "never", 0), build(1, "later", 0)], [("now", 0)]),
             ([build(4, "x", 1)], [("later", 1), ("x", 1)]),
             ([build(5, "x", 4)], [("y", 4)]),
             ([build(6, "x", 5)], [("late", 5)]),
             ([build(2, "late", 6), build(0, "now", 6), build(7, "x", 12)], [("z", 12)]),
             ([build(8, "x", 13)], [("z", 13)])]
    query = None
    for i, (b, c) in enumerate(drops):
        spark.createDataFrame(b, kind).coalesce(1).write.mode("append").parquet(f"{tmp_out}/b")
        spark.createDataFrame([("r", n, T0 + timedelta(hours=h)) for n, h in c], "repo string, commit_sha string, arrived_at timestamp") \
            .coalesce(1).write.mode("append").parquet(f"{tmp_out}/c")
        builds = spark.readStream.schema(kind).parquet(f"{tmp_out}/b")
        commits = spark.readStream.schema("repo string, commit_sha string, arrived_at timestamp").parquet(f"{tmp_out}/c")
        query = start_matching(spark, builds, commits, f"{tmp_out}/o", f"{tmp_out}/ck", expiry=timedelta(hours=2))  # restarts from its checkpoint
        query.awaitTermination()
    ok = sorted(r["sample_id"] for r in spark.read.parquet(f"{tmp_out}/o/accepted").collect())
    assert ok == ["s0", "s1", "s2", "s4", "s5", "s6", "s7", "s8"]
    failed = [(r["sample_id"], r["error"]) for r in spark.read.parquet(f"{tmp_out}/o/failures").collect()]
    assert sorted(failed) == [("s2", "No commit arrived: late"), ("s3", "No commit arrived: never")]
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] <= 8  # flags of the commits that are remembered; no build waits any more


def _drop(spark, out, builds, commits, **args):
    """One drop of builds and commits into the stream; the timers it registers."""
    from buildlens.streaming.pending import BUILD, start_matching
    kind, known = f"{BUILD}, arrived_at timestamp", "repo string, commit_sha string, arrived_at timestamp"
    spark.createDataFrame(builds, kind).write.mode("append").parquet(f"{out}/b")
    spark.createDataFrame(commits, known).write.mode("append").parquet(f"{out}/c")
    query = start_matching(spark, spark.readStream.schema(kind).parquet(f"{out}/b"), spark.readStream.schema(known).parquet(f"{out}/c"),
                           f"{out}/o", f"{out}/ck", expiry=timedelta(hours=2), **args)
    query.awaitTermination()
    return sum(p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress if p["stateOperators"])


def _stored(spark, out, name, *columns):
    return sorted((tuple(r) for r in spark.read.parquet(f"{out}/o/{name}").select(*columns).collect()), key=repr)


def test_many_builds_of_one_commit_wait_as_one(spark, tmp_out):
    """Before, each build that waited cost calls to the state and a timer of its own, so that time went with the builds."""
    odd = ["", None, 'q"], [\\', "é\n\u2028\x00", "null", " "]

    def build(i, commit, at):
        return (i, "r" if i % 2 else None, commit, odd[i % 6], odd[(i + 1) % 6], odd[(i + 2) % 6], [0, 1, None][i % 3], f"s{i}", at)

    first = [build(i, f"c{i % 4}" if i % 4 else None, T0 + timedelta(microseconds=i % 2)) for i in range(3000)]
    assert 0 < _drop(spark, tmp_out, first, [("r", "c1", T0)]) < 20
    _drop(spark, tmp_out, [build(3005, "c1", None), build(3001, "c9", T0 + timedelta(hours=1))], [(None, None, T0 + timedelta(hours=1))])
    _drop(spark, tmp_out, [], [("t", "t", T0 + timedelta(hours=2, minutes=30))])
    _drop(spark, tmp_out, [build(3003, "c9", T0 + timedelta(hours=2, minutes=45))], [("r", "c9", T0 + timedelta(hours=2, minutes=45))])
    late = [build(3005, "c1", None), build(3001, "c9", T0 + timedelta(hours=1)), build(3003, "c9", T0 + timedelta(hours=2, minutes=45))]
    fields = ["source_row_index", "repo", "commit_sha", "parent_commit_sha", "build_id", "raw_status", "label", "sample_id", "arrived_at"]
    kept = [b for b in first if b[1:3] in (("r", "c1"), (None, None))] + late
    assert _stored(spark, tmp_out, "accepted", *fields) == sorted(kept, key=repr)
    failed = [b for b in first if b[1:3] not in (("r", "c1"), (None, None))]
    assert _stored(spark, tmp_out, "failures", *fields[:5], "sample_id") == sorted([(*b[:5], b[7]) for b in failed], key=repr)


def test_packs_and_passes_are_bounded(spark, tmp_out, monkeypatch):
    """Small bounds: a commit's builds come in many texts and passes, with its commit row among them; the same builds go on."""
    import pyarrow as pa
    from buildlens.streaming import pending as P
    monkeypatch.setattr(P, "PACK_ROWS", 3)
    rows = pa.RecordBatch.from_pydict({"repo": ["r"] * 12 + [None], "commit_sha": ["a"] * 8 + ["b"] * 4 + [None], "at": [1] * 13, "builds": [f"[{i}]" for i in range(8)] + [None] * 5})
    made = [tuple(r.values()) for b in P.pack(iter([rows.slice(0, 0), rows])) for r in b.to_pylist()]
    assert all(t is None or t.count("[") <= 3 for *_, t in made)
    assert sorted(t for *_, t in made if t) == ["[0],[1],[2]", "[3],[4],[5]", "[6],[7]"]
    assert {r[:3] for r in made if r[3] is None} == {("r", "b", 1), (None, None, 1)}
    monkeypatch.setattr(P, "CHARS", 4)
    assert list(P._joined({("r", "a", 1): ["[1]", "[2]", "[3]"]})) == [("r", "a", 1, "[1]"), ("r", "a", 1, "[2]"), ("r", "a", 1, "[3]")]
    parts = list(P._frames([("r", "a", 1, "[1]"), ("r", "b", 1, "[2]"), ("r", "c", 1, "[3]")], "failed"))
    assert [list(f["commit_sha"]) for f in parts] == [["a"], ["b"], ["c"]] and set(parts[0]["status"]) == {"failed"}


def test_a_group_meets_in_passes_and_is_swept_once(monkeypatch):
    """Commits after their builds, over several passes; one sweep serves all timers of a batch, and the next end is registered."""
    import pandas as pd
    from buildlens.streaming import pending as P

    class State:
        def __init__(self):
            self.rows, self.calls = [], 0

        def get(self):
            return iter(list(self.rows)) if self.many else (self.rows[0] if self.rows else None)

        def exists(self):
            return bool(self.rows)

        def update(self, row):
            self.rows = [row]

        def put(self, rows):
            self.rows = list(rows)

        def appendList(self, rows):
            self.rows += rows

        def clear(self):
            self.rows = []

    known, waiting, timers = State(), State(), []
    known.many, waiting.many = False, True
    handle = type("Handle", (), {"getValueState": lambda *a: known, "getListState": lambda *a: waiting, "registerTimer": lambda self, t: timers.append(t)})()
    values = lambda now: type("Values", (), {"getCurrentWatermarkInMs": lambda self: now})()
    fired = lambda at: type("Fired", (), {"getExpiryTimeInMs": lambda self: at})()

    def frame(*rows):
        return pd.DataFrame(list(rows), columns=["repo", "commit_sha", "arrived_us", "builds"])

    def task():
        w = P.Waiting(timedelta(milliseconds=10), timedelta(milliseconds=100))
        w.init(handle)
        return w

    def out(frames):
        return sorted(tuple(r) for f in frames for r in f[["commit_sha", "arrived_us", "builds", "status"]].itertuples(index=False))

    monkeypatch.setattr(P, "HELD_ROWS", 2)
    rows = [frame(("r", "a", 1000, "[1]"), ("r", "b", 1000, "[2]")), frame(("r", "a", 3000, "[3]"), ("r", "a", 2000, None)), frame(("r", "a", 5000, "[4]"), ("r", "b", 4000, "[5]"))]
    assert out(task().handleInputRows((1,), iter(rows), values(0))) == [("a", 1000, "[1]", "accepted"), ("a", 3000, "[3]", "accepted"), ("a", 5000, "[4]", "accepted")]
    assert waiting.rows == [("r", "b", 1000, "[2]"), ("r", "b", 4000, "[5]")] and min(timers) == 11
    now, timers[:] = task(), []
    assert out(now.handleExpiredTimer((1,), values(11), fired(11))) == [("b", 1000, "[2]", "failed")]
    assert timers == [14] and out(now.handleExpiredTimer((1,), values(11), fired(11))) == []
    assert out(task().handleExpiredTimer((1,), values(200), fired(14))) == [("b", 4000, "[5]", "failed")]
    assert not known.rows and not waiting.rows
