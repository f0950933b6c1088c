"""Session and checkpoint helpers.

The engine never hand-schedules work: it relies on AQE for partition
coalescing and skew-join splitting, and on Catalyst for pushdown and pruning.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "buildlens", extra: dict | None = None) -> SparkSession:
    """Create or reuse a session with the engine's defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    On a cluster this must be the shared folder named by
    ``spark.checkpoint.dir``.  Only a local-mode session without that
    setting (tests, the bench) gets a private folder under the temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared folder for lineage cuts")
    folder = tempfile.mkdtemp(prefix="buildlens-ckpt-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


@contextmanager
def scoped_conf(spark: SparkSession, settings: dict):
    """Temporarily set runtime SQL confs; previous values are restored.

    Only useful around an eager action (e.g. ``checkpoint(eager=True)``),
    because plans are optimised when they execute.
    """
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def listing_by_few_tasks(spark: SparkSession):
    """While a reader is made: folders with many shards are listed by a few tasks per core, not by one task per shard folder."""
    return scoped_conf(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": 4 * spark.sparkContext.defaultParallelism})
