"""Incremental build ingest with Structured Streaming.

New build files land in a folder.  Each micro-batch normalises them (ids,
labels), drops ``sample_id`` values that it holds twice, that earlier batches have stored
(an anti-join with the output's narrow id columns, so no state grows in memory) or
that were completed before the stream existed, splits off rows whose
commit is unknown as failures, and writes both under ``batch_id=<n>``.  Given the changed files,
it also makes artifacts, vectors and shards of the accepted rows; shard numbers
continue after the earlier batches'.  Writing a batch replaces exactly that batch's
folders and looks at earlier batches only, so a replayed batch is idempotent.  The row
index must come from the producer: file order is not global in a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import resume as R
from ..plans.preprocess import PreprocessConfig, _exists, plan_samples
from ..sources import shards as SH
from ..sources.builds import ColumnRoles, normalize_builds


def _earlier(spark: SparkSession, path: str, batch_id: int, column: str) -> DataFrame | None:
    """``column`` of the batches before ``batch_id``; None when nothing is stored."""
    if not _exists(spark, path):
        return None
    return spark.read.parquet(path).where(F.col("batch_id") < batch_id).select(column)


def _write(df: DataFrame, batch_id: int, path: str, *parts: str) -> None:
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *parts).parquet(path)


def process_batch(batch: DataFrame, batch_id: int, commits: DataFrame, out_dir: str,
                  completed: DataFrame | None = None, commit_files: DataFrame | None = None,
                  cfg: PreprocessConfig | None = None) -> None:
    """One micro-batch of normalised builds: drop known ids -> commit check -> accepted rows, failures
    and, with ``commit_files``, shards and their entries, all under the batch id."""
    spark = batch.sparkSession
    b = batch.dropDuplicates(["sample_id"])
    for known in (completed, _earlier(spark, f"{out_dir}/accepted", batch_id, "sample_id"),
                  _earlier(spark, f"{out_dir}/failures", batch_id, "sample_id")):
        if known is not None:
            b = R.drop_completed(b, known)
    ok, failures = R.split_by_commit_availability(b, commits)
    if commit_files is not None:
        cfg = cfg or PreprocessConfig()
        entries = _earlier(spark, f"{out_dir}/manifest_shards", batch_id, "shard_index")
        last = entries.agg(F.max("shard_index")).first()[0] if entries is not None else None
        sharded = plan_samples(ok, commits, commit_files, cfg, 0 if last is None else last + 1)
        cols = [f.name for f in SH.SHARD_SCHEMA.fields]
        _write(sharded.select(*cols).repartition("shard_index").sortWithinPartitions("shard_index", "record_index"),
               batch_id, f"{out_dir}/shards", "shard_index")
        stored = spark.read.parquet(f"{out_dir}/shards").where(F.col("batch_id") == batch_id)
        _write(SH.manifest_shards(stored), batch_id, f"{out_dir}/manifest_shards")
    _write(failures, batch_id, f"{out_dir}/failures")
    _write(ok, batch_id, f"{out_dir}/accepted")


def start_ingest(spark: SparkSession, source_dir: str, schema: T.StructType, commits: DataFrame, out_dir: str,
                 checkpoint_dir: str, roles: ColumnRoles = ColumnRoles(), completed: DataFrame | None = None,
                 available_now: bool = True, max_files_per_trigger: int | None = None,
                 commit_files: DataFrame | None = None, cfg: PreprocessConfig | None = None):
    """Start the stream (file source, fixed schema); returns the StreamingQuery."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = normalize_builds(reader.parquet(source_dir), roles, index_col="source_row_index")
    writer = stream.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(
        lambda df, bid: process_batch(df, bid, commits, out_dir, completed, commit_files, cfg))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
