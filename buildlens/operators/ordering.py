"""Distributed dense row indices.

A dense 0..n-1 index in a global order is built without an un-partitioned
window: range-partition on the order key, sort inside partitions, tag rows
with ``monotonically_increasing_id`` (partition id in the high bits), cut
lineage with a reliable checkpoint so the tags cannot change on recompute,
then add per-partition offsets from a table with one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_MID = "__bl_mid"
_PID = "__bl_pid"
_CNT = "__bl_cnt"
_OFF = "__bl_off"
_LOW_BITS = (1 << 33) - 1


def _index_from_tags(tagged: DataFrame, name: str) -> DataFrame:
    pid = F.shiftright(F.col(_MID), 33)
    counts = tagged.groupBy(pid.alias(_PID)).agg(F.count(F.lit(1)).alias(_CNT))
    # One row per input partition: the frame is tiny and bounded by the
    # partition count, so an ordered window without partitionBy is safe here.
    offsets = counts.select(
        _PID,
        F.coalesce(F.sum(_CNT).over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias(_OFF))
    joined = tagged.join(F.broadcast(offsets), pid == F.col(_PID), "inner")
    return joined.withColumn(name, (F.col(_OFF) + F.col(_MID).bitwiseAND(F.lit(_LOW_BITS))).cast("long")) \
        .drop(_MID, _PID, _OFF)


def with_global_index(df: DataFrame, order_cols: list[str | Column], name: str = "global_index",
                      num_partitions: int | None = None) -> DataFrame:
    """Add a dense index in the total order given by ``order_cols``.

    ``order_cols`` must make the order total (end with a unique key) for the
    index to be deterministic.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    tagged = ordered.withColumn(_MID, F.monotonically_increasing_id()).checkpoint(eager=True)
    return _index_from_tags(tagged, name)
