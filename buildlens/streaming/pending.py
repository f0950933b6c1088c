"""Builds that wait for their commits (R1): keyed state with expiry instead of a one-shot failure.

A stream of builds and a stream of commits meet on (repo, commit_sha).  A build whose
commit is known goes on at once; any other waits in the state store.  It goes on when
its commit arrives, and fails when the watermark has passed its time plus ``expiry``.  A build
that failed and is delivered again is a new arrival: it goes on if its commit is known by then.

A commit is remembered for ``memory`` after its own time, so the state holds the builds of the last
``expiry`` and one entry per commit of the last ``memory``; timers clear both.  Times are the
producer's (``arrived_at``), so a replay gives the same result.

Python and its state cost by the call and by the row.  So the state is kept for groups of commits (``GROUPS``, by hash),
and a commit's builds of one time come to it as one text, which Spark makes before it and takes apart after it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import resume as R
from ..session import scoped_conf
from ..sources.manifest import exists

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
BUILD = ("source_row_index long, repo string, commit_sha string, parent_commit_sha string, build_id string, raw_status string, "
         "label int, sample_id string")
FIELDS = dict(f.strip().split() for f in BUILD.split(","))
KEY = ["repo", "commit_sha"]
OWN = [name for name in FIELDS if name not in KEY]  # a build's fields besides its commit's, in the order of its text
ROW = "group int, repo string, commit_sha string, arrived_at timestamp, arrived_us long, builds string"
PACK = "repo string, commit_sha string, arrived_us long, builds string"  # builds: JSON arrays with commas between; NULL for a commit
OUT = f"{PACK}, status string"
GROUPS = 4096  # a checkpoint holds for one number
HELD_BYTES = 32 << 20  # rows that a task holds while it packs them
HELD_ROWS = 100_000  # most rows of a group that are looked at together
PACK_ROWS = 4096  # most builds of one text as it comes
CHARS = 8 << 20  # most text that is sent at once, or one pack
NO_TIME = -(1 << 62)  # arrived_us of a row without a time


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per build (a text each) or commit (NULL) -> one per commit, time and kind among the rows that are held at once."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= HELD_BYTES:
            yield from _packed(held)
            held, size = [], 0
    if held:
        yield from _packed(held)


def _packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held)
    rows = rows.append_column("is_commit", pc.is_null(rows["builds"]))
    rows = rows.group_by([c for c in rows.column_names if c != "builds"], use_threads=False).aggregate([("builds", "list")]).combine_chunks()
    n = pc.list_value_length(rows["builds_list"])
    for first in range(0, pc.max(n).as_py(), PACK_ROWS):
        some = rows.filter(pc.greater(n, first))
        texts = pc.binary_join(pc.list_slice(some["builds_list"], first, first + PACK_ROWS), ",")
        yield from some.drop_columns(["is_commit", "builds_list"]).append_column("builds", texts).to_batches()


class Waiting(StatefulProcessor):
    """A group's state: until when its commits are known, and the packs of builds that wait for others.

    One timer per group is enough: it is never later than the first entry that runs out, and when it
    fires, all that has run out by the watermark goes and the next is registered.
    """

    def __init__(self, expiry: timedelta, memory: timedelta):
        self.expiry, self.memory = int(expiry.total_seconds() * 1000), int(memory.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "repo array<string>, commit_sha array<string>, until array<long>")
        self.waiting = handle.getListState("waiting", PACK)
        self.swept = set()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        held, n = [], 0
        for frame in rows:
            held.append(frame)
            n += len(frame)
            if n >= HELD_ROWS:
                yield from self._meet(held, known)
                held, n = [], 0
        if held:
            yield from self._meet(held, known)

    def _meet(self, frames: list[pd.DataFrame], known: dict) -> Iterator[pd.DataFrame]:
        """Commits become known, and builds go on or wait; ``known`` is kept up to date."""
        commits, packs = {}, {}
        for f in frames:
            for repo, sha, at, builds in zip(_strings(f["repo"]), _strings(f["commit_sha"]), f["arrived_us"].tolist(), _strings(f["builds"])):
                if builds is None:
                    commits[repo, sha] = max(at, commits.get((repo, sha), at))
                else:
                    packs.setdefault((repo, sha, at), []).append(builds)
        new = commits.keys() - known.keys()
        until = {c: at // 1000 + self.memory for c, at in commits.items()}
        until = {c: t for c, t in until.items() if t > known.get(c, t - 1)}
        if until:
            known.update(until)
            self._remember(known)
            self.handle.registerTimer(min(until.values()))
        if new and self.waiting.exists():
            left = []
            yield from _frames(_divide(self.waiting.get(), lambda p: (p[0], p[1]) in new, left), "accepted")
            self._wait(left)
        wait = []
        yield from _frames(_divide(_joined(packs), lambda p: (p[0], p[1]) in known, wait), "accepted")
        if any(p[2] == NO_TIME for p in wait):
            raise ValueError("a build without arrived_at can't wait for its commit")
        if wait:
            self.waiting.appendList(wait)
            self.handle.registerTimer(min(self._end(p) for p in wait))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.swept:  # by an earlier timer of this batch
            return
        self.swept.add(key)
        now, next_ends = timerValues.getCurrentWatermarkInMs(), []
        known = self._known()
        remembered = {c: t for c, t in known.items() if t > now}
        if len(remembered) < len(known):
            self._remember(remembered)
        next_ends += remembered.values()
        if self.waiting.exists():
            left = []
            yield from _frames(_divide(self.waiting.get(), lambda p: self._end(p) <= now, left), "failed")
            self._wait(left)
            next_ends += [self._end(p) for p in left]
        if next_ends:
            self.handle.registerTimer(min(next_ends))

    def close(self) -> None:
        pass

    def _end(self, pack: tuple) -> int:
        return pack[2] // 1000 + self.expiry

    def _known(self) -> dict:
        state = self.known.get()
        return {} if state is None else {(repo, sha): t for repo, sha, t in zip(*state)}

    def _remember(self, known: dict) -> None:
        if known:
            self.known.update(([c[0] for c in known], [c[1] for c in known], list(known.values())))
        else:
            self.known.clear()

    def _wait(self, packs: list[tuple]) -> None:
        if packs:
            self.waiting.put(packs)
        else:
            self.waiting.clear()


def _strings(column: pd.Series) -> list:
    return [x if isinstance(x, str) else None for x in column.tolist()]


def _joined(packs: dict) -> Iterator[tuple]:
    for key, texts in packs.items():
        some, chars = [], 0
        for t in texts:
            if some and chars + len(t) > CHARS:
                yield *key, ",".join(some)
                some, chars = [], 0
            some.append(t)
            chars += len(t)
        yield *key, ",".join(some)


def _divide(packs: Iterable[tuple], take, left: list) -> Iterator[tuple]:
    """The packs that ``take`` picks; the others go to ``left``."""
    for p in packs:
        if take(p):
            yield p
        else:
            left.append(p)


def _frames(packs: Iterable[tuple], status: str) -> Iterator[pd.DataFrame]:
    def frame():
        return pd.DataFrame(dict(zip(("repo", "commit_sha", "arrived_us", "builds"), map(list, zip(*held)))) | {"status": status})

    held, chars = [], 0
    for p in packs:
        if held and chars + len(p[3]) > CHARS:
            yield frame()
            held, chars = [], 0
        held.append(p)
        chars += len(p[3])
    if held:
        yield frame()


def match_builds(builds: DataFrame, commits: DataFrame, expiry: timedelta, memory: timedelta, late: str = "0 seconds") -> DataFrame:
    """Streams of normalised builds and of (repo, commit_sha), both with ``arrived_at`` -> builds with ``status`` accepted or failed."""
    key = [F.col(name).cast("string").alias(name) for name in KEY]
    text = F.to_json(F.array(*[F.col(name).cast(FIELDS[name]).cast("string") for name in OWN]))
    both = builds.select(*key, "arrived_at", text.alias("builds")).unionByName(commits.select(*key, "arrived_at", F.lit(None).cast("string").alias("builds")))
    rows = both.withColumn("arrived_us", F.coalesce(F.unix_micros("arrived_at"), F.lit(NO_TIME))).withColumn("group", F.pmod(F.xxhash64(*KEY), F.lit(GROUPS)).cast("int"))
    rows = rows.select(*[f.split()[0] for f in ROW.split(", ")]).repartition("group").mapInArrow(pack, ROW)
    packs = rows.withWatermark("arrived_at", late).groupBy("group").transformWithStateInPandas(
        Waiting(expiry, memory), outputStructType=T.StructType.fromDDL(OUT), outputMode="append", timeMode="eventTime")
    each = packs.select(*KEY, "status", F.when(F.col("arrived_us") != NO_TIME, F.timestamp_micros("arrived_us")).alias("arrived_at"),
                        F.explode(F.from_json(F.concat(F.lit("["), "builds", F.lit("]")), "array<array<string>>", {"mode": "FAILFAST"})).alias("b"))
    own = {name: F.col("b")[i].cast(FIELDS[name]).alias(name) for i, name in enumerate(OWN)}
    return each.select(*[own.get(name, F.col(name)) for name in FIELDS], "status", "arrived_at")


def _batch(batch: DataFrame, batch_id: int, out_dir: str) -> None:
    """Accepted builds that no earlier batch holds, and failure records, under the batch id (a replay replaces its own)."""
    spark = batch.sparkSession
    kept = batch.persist()
    some = kept.where("status = 'accepted'").limit(1).count()  # most batches accept nothing: then the earlier ids aren't read
    ok = kept.where("status = 'accepted'").dropDuplicates(["sample_id"]).drop("status")
    if some and exists(spark, f"{out_dir}/accepted"):
        ok = R.drop_completed(ok, spark.read.parquet(f"{out_dir}/accepted").where(F.col("batch_id") < batch_id).select("sample_id"))
    failed = R.row_failures(kept.where("status = 'failed'"), "sample_processing", F.concat(F.lit("No commit arrived: "), F.col("commit_sha")))
    for df, name in ((ok, "accepted"), (failed, "failures")):
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("batch_id").parquet(f"{out_dir}/{name}")
    kept.unpersist()


def start_matching(spark: SparkSession, builds: DataFrame, commits: DataFrame, out_dir: str, checkpoint_dir: str,
                   expiry: timedelta = timedelta(hours=6), memory: timedelta = timedelta(days=30), available_now: bool = True):
    """Start the stream of ``match_builds`` into ``accepted/`` and ``failures/`` below ``out_dir``; returns the StreamingQuery."""
    writer = match_builds(builds, commits, expiry, memory).writeStream.outputMode("append") \
        .option("checkpointLocation", checkpoint_dir).foreachBatch(lambda df, n: _batch(df, n, out_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    with scoped_conf(spark, STATE_STORE):  # a stream keeps the settings that it is started with
        return writer.start()
