"""Build-table scan and normalisation."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import CSV_NA_TOKENS, normalize_label, normalize_optional, sample_id
from ..operators.ordering import with_global_index
from ..session import ensure_checkpoint_dir
from .csv_records import read_records

# Default column roles of a build table.
DEFAULT_REPO_COL = "gh_project_name"
DEFAULT_COMMIT_COL = "git_trigger_commit"
DEFAULT_LABEL_COL = "tr_status"
DEFAULT_BUILD_ID_COL = "tr_build_id"
DEFAULT_PARENT_COL = "git_prev_built_commit"

LOG = logging.getLogger(__name__)

BUILDS_SCHEMA = T.StructType([
    T.StructField("source_row_index", T.LongType(), False),
    T.StructField("repo", T.StringType(), True),
    T.StructField("commit_sha", T.StringType(), True),
    T.StructField("parent_commit_sha", T.StringType(), True),
    T.StructField("build_id", T.StringType(), True),
    T.StructField("raw_status", T.StringType(), True),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("sample_id", T.StringType(), True),
])


class MissingColumnError(ValueError):
    pass


@dataclass(frozen=True)
class ColumnRoles:
    repo: str = DEFAULT_REPO_COL
    commit: str = DEFAULT_COMMIT_COL
    label: str | None = DEFAULT_LABEL_COL
    build_id: str | None = DEFAULT_BUILD_ID_COL
    parent: str | None = DEFAULT_PARENT_COL


def check_input_exists(spark: SparkSession, path: str) -> None:
    """S3: fail before any work when the input is absent."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        raise FileNotFoundError(f"Input not found: {path}")


def read_builds_csv(spark: SparkSession, path: str, roles: ColumnRoles | None = None) -> DataFrame:
    """Header CSV (one file or a folder of part files), every column read as text;
    pandas-style NA tokens -> NULL; whitespace kept.  ``roles`` keeps their columns only.

    Files are cut into records in parallel (``csv_records``), quoted line ends included.
    P4: ``source_row_index`` is the record's place in file order, files by path.
    """
    check_input_exists(spark, path)
    ensure_checkpoint_dir(spark)
    ordinary = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
                "nullValue": "\u0000never\u0000", "emptyValue": "", "maxCharsPerColumn": "-1"}
    header = spark.read.options(**ordinary, header="true", multiLine="true").csv(path).columns
    fields = ", ".join(f"`{c.replace('`', '``')}` string" for c in header)
    rows = read_records(spark, path).select("source_row_index", F.from_csv("record", fields, ordinary).alias("r"))
    kept = header if roles is None else [c for c in header if c in {roles.repo, roles.commit, roles.label, roles.build_id, roles.parent}]
    na = F.array(*[F.lit(t) for t in CSV_NA_TOKENS])
    value = {c: F.col("r").getField(c) for c in kept}
    return rows.select(*[F.when(F.array_contains(na, v), F.lit(None)).otherwise(v).alias(c) for c, v in value.items()], "source_row_index")


def numeric_columns(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Type of each column whose every non-NULL text parses as a number: "long" when all
    values are integers, else "double" (how a type-inferring CSV reader types them).

    One aggregate pass; two counts per column reach the driver.
    """
    cols = [c for c in cols if c is not None and c in df.columns]
    if not cols:
        return {}
    aggs = []
    for c in cols:
        v = F.col(f"`{c}`")
        aggs += [F.count_if(v.isNotNull() & v.try_cast("double").isNull()).alias(f"{c}__d"),
                 F.count_if(v.isNotNull() & v.try_cast("long").isNull()).alias(f"{c}__l")]
    counts = df.agg(*aggs).first()
    out = {}
    for c in cols:
        if counts[f"{c}__l"] == 0:
            out[c] = "long"
        elif counts[f"{c}__d"] == 0:
            out[c] = "double"
    return out


def normalize_builds_csv(raw: DataFrame, roles: ColumnRoles = ColumnRoles()) -> DataFrame:
    """``normalize_builds`` for a text-typed CSV scan: label and build-id columns that are
    numeric throughout are treated as numbers, as a CSV reader with type inference does
    (so the text "1.0" in an all-numeric status column is the number 1.0, label 1)."""
    df = raw
    for c, typ in numeric_columns(raw, [roles.label, roles.build_id]).items():
        df = df.withColumn(c, F.col(f"`{c}`").try_cast(typ))
    return normalize_builds(df, roles)


def check_columns(df: DataFrame, roles: ColumnRoles) -> list[str]:
    """Required columns must exist; returns warnings for absent optional ones."""
    cols = set(df.columns)
    for required in (roles.repo, roles.commit):
        if required not in cols:
            raise MissingColumnError(
                f"Required column {required!r} not found. Available columns: {sorted(cols)}")
    warnings = []
    for role, name in (("label", roles.label), ("build id", roles.build_id), ("parent commit", roles.parent)):
        if name is not None and name not in cols:
            warnings.append(f"{role} column {name!r} not found; values will be missing")
    return warnings


def normalize_builds(df: DataFrame, roles: ColumnRoles = ColumnRoles(),
                     index_col: str | None = "source_row_index",
                     order_cols: list[str] | None = None,
                     build_id_numeric: bool = False) -> DataFrame:
    """Raw build rows -> ``builds`` (P1-P6) in one projection.

    ``index_col`` names an existing row index; otherwise ``order_cols`` give
    the total order for a distributed dense index (P4).
    """
    for warning in check_columns(df, roles):
        LOG.warning(warning)
    if index_col is None or index_col not in df.columns:
        if not order_cols:
            raise ValueError("no row index column and no order columns given")
        df = with_global_index(df, order_cols, name="source_row_index")
        index_col = "source_row_index"
    cols = set(df.columns)
    types = dict((f.name, f.dataType) for f in df.schema.fields)

    def optional(name: str | None) -> F.Column:
        if name is None or name not in cols:
            return F.lit(None).cast("string")
        dtype = types[name]
        if build_id_numeric and name == roles.build_id and isinstance(dtype, T.StringType):
            s = normalize_optional(F.col(f"`{name}`"), dtype)
            return F.regexp_replace(s, "\\.0$", "")
        return normalize_optional(F.col(f"`{name}`"), dtype)

    label = (normalize_label(F.col(f"`{roles.label}`"), types[roles.label])
             if roles.label in cols else F.lit(None).cast("int"))
    raw_status = (F.col(f"`{roles.label}`").cast("string") if roles.label in cols
                  else F.lit(None).cast("string"))
    out = df.select(
        F.col(f"`{index_col}`").cast("long").alias("source_row_index"),
        F.col(f"`{roles.repo}`").cast("string").alias("repo"),
        F.col(f"`{roles.commit}`").cast("string").alias("commit_sha"),
        optional(roles.parent).alias("parent_commit_sha"),
        optional(roles.build_id).alias("build_id"),
        raw_status.alias("raw_status"),
        label.alias("label"))
    return out.withColumn("sample_id", sample_id(F.col("repo"), F.col("commit_sha"), F.col("build_id"),
                                                 F.col("source_row_index")))


def repo_groups(builds: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """G1: repos in ascending order, rows in source order inside each repo.

    Range partitioning on (repo, source_row_index) keeps that global order
    while a repo holding a third of all rows still spreads over many
    partitions (hash partitioning on the repo alone would put it in one task).
    """
    n = num_partitions or int(builds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return builds.repartitionByRange(n, "repo", "source_row_index").sortWithinPartitions("repo", "source_row_index")


def first_repos(builds: DataFrame, max_repos: int | None) -> DataFrame:
    """Keep the first ``max_repos`` repos in ascending name order.

    The kept list has at most ``max_repos`` rows; Spark picks the join by its size.
    """
    if max_repos is None:
        return builds
    if max_repos < 0:
        raise ValueError("max_repos must be >= 0")
    kept = builds.select("repo").where(F.col("repo").isNotNull()).distinct() \
        .orderBy("repo").limit(max_repos)
    return builds.join(kept, "repo", "left_semi")
