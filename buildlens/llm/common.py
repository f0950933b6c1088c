"""Helpers that the corpus operators share: tables, scratch folder, checkpoints, components.

Every lineage cut is a Parquet table (or a reliable checkpoint) in the folder
that ``spark.checkpoint.dir`` names, so a lost executor never loses it.
"""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scoped_conf

#: Shuffle files of a job whose result is stored are of no more use.
CLEAN_UP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"


def store(df: DataFrame, what: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; ``batch_rows``: rows that a Python task gets at once."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    with scoped_conf(spark, CLEAN_UP | ({} if batch_rows is None else {"spark.sql.execution.arrow.maxRecordsPerBatch": batch_rows})):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(scan):
    """``scan`` (a Python task's function over batches), after which the worker gives back the memory that it no longer uses.

    Spark keeps the workers of earlier stages and deals the next tasks out to all of them in turn, so what Arrow and malloc hold on to adds up.
    """

    def run(batches):
        yield from scan(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id"):
    """Whether a row belongs to the held-out quarter: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b), both long.

    Returns (node, component) with the smallest node id of each component, for
    every node that has an edge.  Large-star and small-star steps: each round
    links every node to the smallest neighbour, so a long chain takes a
    logarithmic number of rounds and a star of any size one.  A star's centre
    is only ever aggregated (a partial minimum), and its edges are rows of
    their own, so a large component is never gathered in one task.
    """
    cur = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .filter("a <> b").distinct(), "cc")
    state = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    old = state(cur)
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b")  # as many rows as edges at most; made distinct with the rest below
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(down.select("a", F.col("m").alias("b")))
                 .filter("a <> b")
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        new = store(small, "cc")
        seen = state(new)
        cur = new
        if seen == old:
            break
        old = seen
    else:
        raise RuntimeError("components did not converge")
    return (cur.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
            .unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
