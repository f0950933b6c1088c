"""Shard, sidecar and manifest sinks and scans.

Shards are one Parquet dataset partitioned by ``shard_index`` (vectors and
keys) plus one gzip JSON dataset with the same partitioning (texts and
provenance).  Spark's commit protocol replaces temp-file promotion; the
manifest is written last, after both datasets have committed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import shard_index_of, shard_name
from ..operators.ordering import with_global_index
from ..session import ensure_checkpoint_dir, listing_by_few_tasks

FORMAT_VERSION = 1
DEFAULT_SHARD_SIZE = 5000

# The fields every stored shard row carries.
REQUIRED_SHARD_FIELDS = ["shard_index", "record_index", "sample_id", "repo", "commit_sha", "build_id",
                         "label", "message_embedding", "diff_embedding", "context_embedding"]

VEC = T.ArrayType(T.FloatType(), True)
SHARD_SCHEMA = T.StructType([
    T.StructField("record_index", T.IntegerType(), False),
    T.StructField("sample_id", T.StringType(), False),
    T.StructField("repo", T.StringType(), True),
    T.StructField("commit_sha", T.StringType(), True),
    T.StructField("build_id", T.StringType(), True),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("message_embedding", VEC, True),
    T.StructField("diff_embedding", VEC, True),
    T.StructField("context_embedding", VEC, True),
    T.StructField("shard_index", T.IntegerType(), False),
])


class ShardValidationError(ValueError):
    pass


class OutputExistsError(FileExistsError):
    pass


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/buildlens-scratch/{uuid.uuid4().hex}/{name}"


# ------------------------------------------------------------------ G3
def assign_shards(samples: DataFrame, order_cols: list[str], shard_size: int = DEFAULT_SHARD_SIZE,
                  first_shard: int = 0) -> DataFrame:
    """Position in global order -> (shard_index, record_index); the last shard may be short.

    ``first_shard`` continues numbering after a resume.
    """
    if shard_size <= 0:
        raise ValueError("shard_size must be positive")
    indexed = with_global_index(samples, order_cols, name="_pos")
    return indexed.withColumn("shard_index", (F.lit(first_shard) + F.floor(F.col("_pos") / shard_size)).cast("int")) \
        .withColumn("record_index", (F.col("_pos") % shard_size).cast("int")).drop("_pos")


# ------------------------------------------------------------------ S6 / S7 / S14
def _check_output(spark: SparkSession, path: str, overwrite: bool) -> None:
    """Refuse an existing output unless overwrite is asked for."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hpath) and not overwrite:
        raise OutputExistsError(f"Output already exists: {path}; pass overwrite=True to replace it")


def write_shards(shards: DataFrame, path: str, overwrite: bool = False, append: bool = False,
                 one_file_per_shard: bool = True) -> None:
    """Vectors + keys, partitioned by ``shard_index``.

    ``one_file_per_shard`` routes each shard to one task (a shard holds at
    most ``shard_size`` rows, so the task is bounded).  Input that is already
    range-partitioned in shard order (see ``assign_shards``) can skip that
    shuffle: a shard then spans at most two part files of its directory.
    """
    if not append:
        _check_output(shards.sparkSession, path, overwrite)
    cols = [f.name for f in SHARD_SCHEMA.fields]
    out = shards.select(*cols)
    if one_file_per_shard:
        out = out.repartition("shard_index")
    out = out.sortWithinPartitions("shard_index", "record_index")
    mode = "append" if append else ("overwrite" if overwrite else "errorifexists")
    out.write.mode(mode).partitionBy("shard_index").parquet(path)


def sidecar_records(samples: DataFrame) -> DataFrame:
    """Row-oriented text sidecar: ids, label and the three text artifacts."""
    keep = [c for c in ("message", "diff", "context") if c in samples.columns]
    return samples.select("shard_index", "record_index", "sample_id", "source_row_index", "repo", "commit_sha",
                          "parent_commit_sha", "build_id", "label", *keep)


def write_sidecar(records: DataFrame, path: str, overwrite: bool = False, append: bool = False,
                  one_file_per_shard: bool = True) -> None:
    """Gzip JSON lines partitioned like the shards; NULL fields kept."""
    if not append:
        _check_output(records.sparkSession, path, overwrite)
    mode = "append" if append else ("overwrite" if overwrite else "errorifexists")
    if one_file_per_shard:
        records = records.repartition("shard_index")
    records.sortWithinPartitions("shard_index", "record_index") \
        .write.mode(mode).option("compression", "gzip").option("ignoreNullFields", "false") \
        .partitionBy("shard_index").json(path)


def sidecar_json(records: DataFrame) -> DataFrame:
    """P10: each sidecar record as one JSON text (nested values kept, NULLs written)."""
    cols = [c for c in records.columns if c != "shard_index"]
    return records.select("shard_index", "record_index",
                          F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


# ------------------------------------------------------------------ S9 / S10 / S19
def read_shards(spark: SparkSession, path: str, glob: str = "*.parquet", require_files: bool = False) -> DataFrame:
    """Fixed-schema scan of all shard files; ``.tmp`` names never match the glob.

    A missing folder fails at analysis; ``require_files`` also fails when the
    glob matches no file (checked on the file listing, content not read).
    """
    if require_files:
        with listing_by_few_tasks(spark):
            listing = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
                .option("recursiveFileLookup", "true").load(path).select("path")
        if listing.limit(1).count() == 0:
            raise FileNotFoundError(f"no shard files matching {glob!r} under {path}")
    with listing_by_few_tasks(spark):
        return spark.read.schema(SHARD_SCHEMA).option("pathGlobFilter", glob).parquet(path)


def first_n_from_shards(shards: DataFrame, entries: DataFrame, n: int | None, whole_shards: bool = False) -> DataFrame:
    """L1 with limit pushdown (``whole_shards``: all rows of the shards that hold them): the first ``n`` samples in shard order (all when ``n`` is None),
    reading only the shards that hold them, with their ``global_index``.

    ``entries`` is the manifest's (shard_index, num_samples) table -- one row
    per shard.  Its running counts give each shard's offset; the last shard
    needed is one number to the driver and becomes a literal filter on the
    ``shard_index`` partition column, so later shard folders are never read.
    A row's global index is its shard's offset plus its record index.
    """
    if n is not None and n < 0:
        raise ValueError("num_samples must be >= 0")
    w = Window.orderBy("shard_index").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard: a small, bounded table
    before = entries.select("shard_index", F.coalesce(F.sum("num_samples").over(w), F.lit(0)).alias("_before"))
    if n is not None:
        last = before.where(F.col("_before") < n).agg(F.max("shard_index")).first()[0]
        if last is None:
            return shards.limit(0).withColumn("global_index", F.lit(None).cast("long"))
        shards = shards.where(F.col("shard_index") <= F.lit(int(last)))
        before = before.where(F.col("shard_index") <= F.lit(int(last)))
    out = shards.join(before, "shard_index") \
        .withColumn("global_index", (F.col("_before") + F.col("record_index")).cast("long")).drop("_before")
    return out if n is None or whole_shards else out.where(F.col("global_index") < n)


def read_sidecar(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Sidecar scan with an explicit schema (blank lines are skipped by the reader)."""
    with listing_by_few_tasks(spark):
        return spark.read.schema(schema).json(path)


# ------------------------------------------------------------------ S4 / S15 / J7 / U1
def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` with size and shard index parsed from the directory name."""
    with listing_by_few_tasks(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path) \
            .select("path", "length", "modificationTime")
    return files.withColumn("shard_index", F.regexp_extract("path", "shard_index=(\\d+)", 1).try_cast("int"))


def file_checksums(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """sha256 of every file (content read per file by the binaryFile source)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    with listing_by_few_tasks(spark):
        return reader.load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def shard_listing_from_names(names: DataFrame, name_col: str = "name") -> DataFrame:
    """P9/S15 helper: kind (vectors / text / tmp) and index for shard-style file names."""
    n = F.col(name_col)
    kind = (F.when(n.endswith(".tmp"), F.lit("tmp"))
            .when(n.endswith(".pt") | n.endswith(".parquet"), F.lit("vectors"))
            .when(n.endswith(".jsonl.gz") | n.endswith(".json.gz"), F.lit("text")))
    return names.select(name_col, kind.alias("kind"), shard_index_of(n).alias("shard_index"))


def unpaired_shards(listing: DataFrame) -> DataFrame:
    """Shard indices with a vector file but no text file, or the reverse."""
    vec = listing.where(F.col("kind") == "vectors").select("shard_index").distinct()
    txt = listing.where(F.col("kind") == "text").select("shard_index").distinct()
    return vec.exceptAll(txt).withColumn("missing", F.lit("text")) \
        .unionByName(txt.exceptAll(vec).withColumn("missing", F.lit("vectors")))


def shard_states(listing: DataFrame) -> DataFrame:
    """S15 per shard: which file kinds exist and the shard's state
    (interrupted: a temp file; unpaired: vectors or text missing; complete)."""
    per = listing.groupBy("shard_index").agg(
        F.max((F.col("kind") == "vectors").cast("int")).alias("has_vectors"),
        F.max((F.col("kind") == "text").cast("int")).alias("has_text"),
        F.max((F.col("kind") == "tmp").cast("int")).alias("has_tmp"))
    state = (F.when(F.col("has_tmp") == 1, F.lit("interrupted"))
             .when((F.col("has_vectors") + F.col("has_text")) == 1, F.lit("unpaired"))
             .otherwise(F.lit("complete")))
    return per.select("shard_index", (F.col("has_vectors") == 1).alias("has_vectors"),
                      (F.col("has_text") == 1).alias("has_text"), (F.col("has_tmp") == 1).alias("has_tmp"),
                      state.alias("state"))


def output_state(listing: DataFrame, manifest_present: bool) -> str:
    """Interrupted (tmp files) > unpaired > manifest present > complete/empty.

    The listing is reduced to four counts by one aggregate before reaching the driver.
    """
    counts = listing.agg(F.count_if(F.col("kind") == "tmp").alias("tmp"),
                         F.count(F.lit(1)).alias("files")).first()
    if counts["tmp"] > 0:
        return "interrupted"
    if unpaired_shards(listing).limit(1).count() > 0:
        return "unpaired"
    if manifest_present:
        return "manifest_present"
    return "complete" if counts["files"] > 0 else "empty"


def orphan_shards(listing: DataFrame, manifest_shards: DataFrame) -> DataFrame:
    """Files whose shard is not in the manifest: tmp -> delete, half pair -> delete,
    full unlisted pair -> refuse."""
    listed = manifest_shards.select("shard_index").distinct()
    unlisted = listing.where(F.col("kind") != "tmp").join(listed, "shard_index", "left_anti")
    per = unlisted.groupBy("shard_index").agg(F.count_distinct("kind").alias("n_kinds"))
    actions = per.select("shard_index", "n_kinds",
                         F.when(F.col("n_kinds") >= 2, F.lit("refuse")).otherwise(F.lit("delete")).alias("action"))
    tmp = listing.where(F.col("kind") == "tmp").select("shard_index", F.lit(0).cast("long").alias("n_kinds"),
                                                        F.lit("delete").alias("action"))
    return actions.unionByName(tmp)


# ------------------------------------------------------------------ G4 / G5 / J4 / J5
def shard_report(shards: DataFrame) -> DataFrame:
    """Per shard counts and index checks; ``valid`` must hold for every shard."""
    r = shards.groupBy("shard_index").agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.count_distinct("sample_id").alias("distinct_ids"),
        F.min("record_index").alias("min_record"), F.max("record_index").alias("max_record"),
        F.count_distinct("record_index").alias("distinct_records"))
    valid = ((F.col("num_samples") >= 1) & (F.col("distinct_ids") == F.col("num_samples"))
             & (F.col("min_record") == 0) & (F.col("max_record") == F.col("num_samples") - 1)
             & (F.col("distinct_records") == F.col("num_samples")))
    return r.withColumn("valid", valid)


def validate_shards(shards: DataFrame) -> None:
    """G4 as a check: raises with the first bad shards (a bounded sample of the report)."""
    bad = shard_report(shards).where(~F.col("valid")).limit(10).collect()
    if bad:
        raise ShardValidationError(f"invalid shards: {[r.asDict() for r in bad]}")


def duplicate_ids(new_ids: DataFrame, committed_ids: DataFrame) -> DataFrame:
    """Ids that already exist in committed shards, or twice in the new batch."""
    tagged = new_ids.select("sample_id", F.lit(1).alias("new"), F.lit(0).alias("old")).unionByName(
        committed_ids.select("sample_id", F.lit(0).alias("new"), F.lit(1).alias("old")))
    g = tagged.groupBy("sample_id").agg(F.sum("new").alias("n_new"), F.sum("old").alias("n_committed"))
    return g.where((F.col("n_new") >= 1) & (F.col("n_new") + F.col("n_committed") > 1))


def sidecar_alignment(payload: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Full outer join on (shard_index, record_index); rows where a side is missing or ids differ."""
    p = payload.select("shard_index", "record_index", F.col("sample_id").alias("payload_id"))
    s = sidecar.select("shard_index", "record_index", F.col("sample_id").alias("sidecar_id"))
    j = p.join(s, ["shard_index", "record_index"], "full_outer")
    return j.where(F.col("payload_id").isNull() | F.col("sidecar_id").isNull()
                   | (F.col("payload_id") != F.col("sidecar_id")))


def repair_labels(samples: DataFrame, label: str = "label", sidecar_label: str = "sidecar_label") -> DataFrame:
    """Missing labels come from the sidecar; labels that are there stay.

    ``label_error`` marks rows without a sidecar label in shards that hold a
    gap (training refuses such shards).  Only one flag per shard is aggregated.
    """
    gaps = samples.groupBy("shard_index").agg(F.bool_or(F.col(label).isNull()).alias("_needs"))
    return samples.join(gaps, "shard_index").select(
        *samples.columns, F.coalesce(label, sidecar_label).alias("label_repaired"),
        (F.col("_needs") & F.col(sidecar_label).isNull()).alias("label_error"))


# ------------------------------------------------------------------ S8 / G6 / G7
def manifest_shards(shards: DataFrame, checksums: DataFrame | None = None) -> DataFrame:
    """One manifest entry per shard: index, file name, sample count (+ checksums)."""
    m = shards.groupBy("shard_index").agg(F.count(F.lit(1)).alias("num_samples")) \
        .withColumn("shard_name", shard_name(F.col("shard_index")))
    if checksums is not None:
        c = checksums.groupBy("shard_index").agg(
            F.min_by("sha256", "path").alias("vectors_sha256"), F.count(F.lit(1)).alias("n_files"))
        m = m.join(c, "shard_index", "left")
    return m


def validate_manifest(entries: DataFrame) -> DataFrame:
    """Indices unique and contiguous from 0, names equal to indices, counts positive.

    Contiguity needs no ordering: with n entries, n distinct indices, min 0
    and max n-1 hold exactly for 0..n-1.  One aggregate, one row out.
    """
    return entries.agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count_distinct("shard_index").alias("n_distinct"),
        F.min("shard_index").alias("min_index"), F.max("shard_index").alias("max_index"),
        F.count_if(F.col("shard_name") != shard_name(F.col("shard_index"))).alias("bad_names"),
        F.count_if(F.col("num_samples") <= 0).alias("bad_counts"),
        F.sum("num_samples").alias("total_samples")).withColumn(
        "valid", (F.col("n_distinct") == F.col("n_entries")) & (F.col("min_index") == 0)
        & (F.col("max_index") == F.col("n_entries") - 1) & (F.col("bad_names") == 0) & (F.col("bad_counts") == 0))


def manifest_totals(entries: DataFrame, failed: DataFrame) -> DataFrame:
    """Totals: successful samples, failed samples of this run, shard count."""
    t = entries.select(F.col("num_samples").alias("_n"), F.lit(1).alias("_s"), F.lit(0).alias("_f")) \
        .unionByName(failed.select(F.lit(0).alias("_n"), F.lit(0).alias("_s"), F.lit(1).alias("_f")))
    return t.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("successful_samples"),
                 F.coalesce(F.sum("_f"), F.lit(0)).alias("failed_samples"),
                 F.coalesce(F.sum("_s"), F.lit(0)).alias("shards"))


def missing_keys(present: DataFrame, array_col: str = "present_keys") -> DataFrame:
    """Required minus present field names, per row of ``present``."""
    req = F.array(*[F.lit(k) for k in REQUIRED_SHARD_FIELDS])
    return present.withColumn("missing_keys", F.array_sort(F.array_except(req, F.col(array_col))))


# ------------------------------------------------------------------ S8 document / S16 / S18
def write_manifest(spark: SparkSession, path: str, entries: DataFrame, totals: DataFrame, dataset: dict,
                   embedding: dict, preprocessing: dict, run_record: dict, config_json: str | None = None) -> None:
    """The manifest as one JSON document, written after shards and sidecar committed.

    ``shards`` is the per-shard entry list (one element per shard: a small,
    bounded table); totals come from ``manifest_totals``.
    """
    import json
    shards = entries.select(F.struct(*entries.columns).alias("e")).agg(
        F.array_sort(F.collect_list("e")).alias("shards"))
    doc = shards.select(
        F.lit(FORMAT_VERSION).alias("format_version"),
        F.from_json(F.lit(json.dumps(dataset)), "map<string,string>").alias("dataset"),
        F.from_json(F.lit(json.dumps(embedding)), "map<string,string>").alias("embedding"),
        F.from_json(F.lit(json.dumps(preprocessing)), "map<string,string>").alias("preprocessing"),
        "shards")
    first = totals.first()  # one aggregate row: three counts
    doc = doc.withColumn("totals", F.struct(*[F.lit(first[c]).alias(c) for c in totals.columns]))
    doc = doc.withColumn("runs", F.array(F.from_json(F.lit(json.dumps(run_record)), "map<string,string>")))
    doc = doc.withColumn("config_json", F.lit(config_json))
    doc.coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest document back as a one-row DataFrame (its shard list exploded by the caller)."""
    return spark.read.json(path)


def write_result_table(df: DataFrame, path: str) -> None:
    """Result tables as header CSV."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_predictions(scored: DataFrame, path: str) -> None:
    """One row per scored sample (probability, prediction, label, attention) as JSON."""
    scored.write.mode("overwrite").json(path)


def verify_checksums(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """G6 (checksums): files whose recorded sha256 differs from the current one, or that are
    missing on either side.  Both inputs: (path, sha256); joined on the shard folder plus
    file name (part-file names repeat across shard folders)."""
    name = F.regexp_extract(F.col("path"), "([^/]+/[^/]+)$", 1)
    r = recorded.select(name.alias("file"), F.col("sha256").alias("recorded"))
    c = current.select(name.alias("file"), F.col("sha256").alias("current"))
    j = r.join(c, "file", "full_outer")
    return j.where(~F.col("recorded").eqNullSafe(F.col("current")))
