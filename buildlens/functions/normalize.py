"""Scalar normalisers (ids, labels, optional values) as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import py_strip

# Build-status words that map to a label (compared after strip + lower).
SUCCESS_WORDS = ["1", "pass", "passed", "success", "successful", "succeeded", "true", "yes", "y"]

# The default missing-value tokens of pandas.read_csv (public pandas docs).
CSV_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                 "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

SAMPLE_ID_PREFIX = "sha256:"


def _is_fractional(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType))


def _is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def normalize_optional(c: Column, dtype: T.DataType) -> Column:
    """Optional value -> trimmed text or NULL.

    Strings are stripped, blank -> NULL; NaN -> NULL; integer-valued reals
    print as integers; booleans print as ``True``/``False``.
    """
    if isinstance(dtype, T.StringType):
        return F.nullif(py_strip(c), F.lit(""))
    if _is_fractional(dtype):
        d = c.cast("double")
        return (F.when(d.isNull() | F.isnan(d), F.lit(None).cast("string"))
                .when(d == F.floor(d), d.cast("decimal(38,0)").cast("string"))
                .otherwise(d.cast("string")))
    if _is_integral(dtype):
        return c.cast("string")
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


def normalize_label(c: Column, dtype: T.DataType) -> Column:
    """Build status -> 1 / 0 / NULL.

    Text: success words -> 1, blank -> NULL, any other text -> 0.  Numbers: 1 iff equal to 1.0.  Booleans: 0/1.
    """
    if isinstance(dtype, T.BooleanType):
        return c.cast("int")
    if _is_fractional(dtype) or _is_integral(dtype):
        d = c.cast("double")
        return (F.when(d.isNull() | F.isnan(d), F.lit(None).cast("int"))
                .when(d == 1.0, F.lit(1)).otherwise(F.lit(0)))
    s = F.lower(py_strip(c.cast("string")))
    return (F.when(c.isNull(), F.lit(None).cast("int"))
            .when(s == "", F.lit(None).cast("int"))
            .when(s.isin(SUCCESS_WORDS), F.lit(1))
            .otherwise(F.lit(0)))


def sample_id(repo: Column, commit: Column, build_id: Column, row_index: Column) -> Column:
    """Deterministic id: sha256 over repo, commit, build id ('' if NULL), row index."""
    canonical = F.concat_ws("\n", repo, commit, F.coalesce(build_id, F.lit("")),
                            row_index.cast("string"))
    return F.concat(F.lit(SAMPLE_ID_PREFIX), F.sha2(canonical, 256))


def labels_float(label: Column) -> Column:
    """Label as float with NULL kept for missing."""
    return label.cast("float")


def portable_path(path: Column) -> Column:
    """Last path component."""
    return F.element_at(F.split(path, "/"), -1)


def shard_name(index: Column, prefix: str = "shard_") -> Column:
    """Shard index -> zero-padded name."""
    return F.format_string(prefix + "%05d", index)


def shard_index_of(name: Column, prefix: str = "shard_") -> Column:
    """Shard name -> index; NULL when the name does not parse."""
    digits = F.regexp_extract(name, "^" + prefix + "(\\d+)", 1)
    return F.when(digits == "", F.lit(None).cast("int")).otherwise(digits.try_cast("int"))


def iso_utc(ts: Column) -> Column:
    """Timestamp -> ISO-8601 UTC text with ``Z``; fraction only when non-zero.

    Session time zone must be UTC (the engine default) so the wall clock is UTC.
    """
    ts = ts.cast("timestamp")  # TIMESTAMP_NTZ reads as a UTC wall clock
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(ts.isNull(), F.lit(None)).when(
        micros == 0, F.concat(base, F.lit("Z"))).otherwise(
        F.concat(base, F.lit("."), F.lpad(micros.cast("string"), 6, "0"), F.lit("Z")))


def diff_git_paths(line: Column) -> Column:
    """``diff --git a/x b/y`` -> struct(old_path, new_path); prefixes a/ b/ dropped.

    The remainder is split on single spaces; fewer than two parts -> both NULL.
    """
    rest = F.substring(line, len("diff --git ") + 1, 1 << 30)
    parts = F.split(rest, " ", -1)
    ok = F.size(parts) >= 2

    def strip_prefix(p: Column) -> Column:
        return F.when(p.startswith("a/") | p.startswith("b/"), F.substring(p, 3, 1 << 30)).otherwise(p)

    return F.struct(
        F.when(ok, strip_prefix(F.element_at(parts, 1))).alias("old_path"),
        F.when(ok, strip_prefix(F.element_at(parts, 2))).alias("new_path"))


def threshold_predict(logit: Column, threshold: float = 0.5) -> Column:
    """sigmoid(logit) >= threshold -> 1/0."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be in [0, 1]")
    return ((F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))) >= F.lit(threshold)).cast("int")
