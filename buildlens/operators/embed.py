"""Token metadata and text embeddings.

The embedder is pluggable: anything with ``metadata()`` and
``embed(list[str]) -> (n, dim) float array`` runs as an iterator pandas UDF
(Arrow batches; the model is built once per task).  The built-in
``HashingEmbedder`` needs no model files: whitespace tokens are hashed with
md5 into ``dim`` signed buckets and mean-pooled.  ``with_hash_embedding`` does
the same with Spark's own tokenising, each different token of a part of an Arrow
batch hashed once, and one numpy scatter-add.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip

DEFAULT_MAX_LENGTH = 512
SPECIAL_TOKENS = 2  # sequence start and end markers counted by the tokenizer
SPACES = "(?U)[\\s\\x1c-\\x1f]+"
POOLED_ROWS = 512   # rows of an Arrow batch that are hashed and pooled at once


# ------------------------------------------------------------------ E1
def whitespace_tokens(text: Column) -> Column:
    """``str.split()`` tokens; NULL text -> no tokens.

    Python's whitespace is Unicode White_Space plus the separators 0x1c-0x1f.
    """
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda x: x != "")


def token_metadata(text: Column, max_length: int = DEFAULT_MAX_LENGTH) -> Column:
    """struct(token_count_before_truncation, retained_token_count, was_tokenizer_truncated)."""
    counted = F.array(F.size(whitespace_tokens(text)) + SPECIAL_TOKENS)  # a lambda's argument is made once; three uses would split the text three times
    return F.get(F.transform(counted, lambda n: F.struct(
        n.alias("token_count_before_truncation"), F.least(n, F.lit(max_length)).alias("retained_token_count"),
        (n > max_length).alias("was_tokenizer_truncated"))), F.lit(0))


# ------------------------------------------------------------------ E2 / E3: hashing
def retained_tokens(text: Column, max_length: int = DEFAULT_MAX_LENGTH) -> Column:
    """The first ``max_length - SPECIAL_TOKENS`` whitespace tokens; the rest of the text is not split."""
    keep = max_length - SPECIAL_TOKENS
    parts = F.split(py_strip(F.coalesce(text, F.lit(""))), SPACES, keep + 1)
    return F.filter(F.slice(parts, 1, keep), lambda x: x != "")


def token_codes(tokens: list[str], dim: int) -> np.ndarray:
    """2 * bucket + (1 for a negative sign) of each token: bucket = first 8 hex digits of
    md5(token) mod dim; the sign is negative when the 9th hex digit is odd."""
    v = np.frombuffer(b"".join([hashlib.md5(t.encode()).digest()[:8] for t in tokens]), ">u8").astype(np.uint64) >> np.uint64(28)
    return (2 * ((v >> np.uint64(4)) % np.uint64(dim)) + (v & np.uint64(1))).astype(np.int64)


def pooled_vector(tokens: Column, dim: int) -> Column:
    """Mean of the signed one-hot token vectors, sum per bucket / max(token count, 1).

    One scatter-add per ``POOLED_ROWS`` rows, whose different tokens are hashed once: the work is
    one step per token, whatever ``dim`` is.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType(), False))
    def pool(batch: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(batch), POOLED_ROWS):
            part = batch.slice(at, POOLED_ROWS)
            size, words = np.diff(part.offsets.to_numpy()), part.flatten().dictionary_encode()
            codes = token_codes(words.dictionary.to_pylist(), dim)[words.indices.to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(len(part)), size)
            total = np.bincount(row * dim + codes // 2, 1.0 - 2.0 * (codes & 1), len(part) * dim).reshape(len(part), dim)
            out.append((total / np.maximum(size, 1)[:, None]).astype(np.float32).ravel())
        mean = np.concatenate(out) if out else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dim), pa.array(mean))

    return pool(tokens)


def with_hash_embedding(df: DataFrame, text_col: str, out_col: str, dim: int = 64,
                        max_length: int = DEFAULT_MAX_LENGTH) -> DataFrame:
    """E2+E3: tokens are cut by Spark functions, hashed and pooled per Arrow batch."""
    return df.withColumn(out_col, pooled_vector(retained_tokens(F.col(text_col), max_length), dim))


# ------------------------------------------------------------------ pluggable embedder
class HashingEmbedder:
    """Model-free embedder equal to ``hash_embedding`` (numpy, per Arrow batch)."""

    def __init__(self, dim: int = 64, max_length: int = DEFAULT_MAX_LENGTH, half_precision: bool = False):
        self.dim = dim
        self.max_length = max_length
        self.half_precision = half_precision

    def metadata(self) -> dict:
        return {"model_name": "md5-feature-hashing", "max_length": self.max_length, "pooling": "mean",
                "embedding_dim": self.dim, "dtype": "float16" if self.half_precision else "float32",
                "device": "cpu"}

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        keep = self.max_length - SPECIAL_TOKENS
        for row, text in enumerate(texts):
            toks = (text or "").split()[:keep]
            for t in toks:
                h = hashlib.md5(t.encode("utf-8")).hexdigest()
                out[row, int(h[:8], 16) % self.dim] += -1.0 if int(h[8], 16) % 2 else 1.0
            out[row] /= max(len(toks), 1)
        out = out.astype(np.float32)
        if self.half_precision:
            out = half_round(out)
        return out


def half_round(vectors: np.ndarray) -> np.ndarray:
    """Round to half precision and back (storage precision of the vectors)."""
    return vectors.astype(np.float16).astype(np.float32)


def embed_columns(df: DataFrame, text_cols: dict[str, str], embedder_factory) -> DataFrame:
    """Add one ``array<float>`` column per text column with one iterator pandas UDF.

    All text columns go through the same UDF call, so ``embedder_factory``
    (a picklable zero-argument callable) builds the model once per task and
    each Arrow batch is embedded for every column in one pass.  NULL text
    embeds as "".
    """
    outs = list(text_cols)
    vec = T.ArrayType(T.FloatType(), False)
    struct_type = T.StructType([T.StructField(o, vec, False) for o in outs])

    @F.pandas_udf(struct_type)
    def _embed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        model = embedder_factory()
        for cols in batches:
            if isinstance(cols, pd.Series):
                cols = (cols,)
            yield pd.DataFrame({o: list(model.embed(c.fillna("").tolist())) for o, c in zip(outs, cols)})

    tmp = "__bl_embedded"
    df = df.withColumn(tmp, _embed(*[F.col(c) for c in text_cols.values()]))
    for o in outs:
        df = df.withColumn(o, F.col(f"{tmp}.{o}"))
    return df.drop(tmp)


# ------------------------------------------------------------------ E3 on a vector table
def mean_vectors(df: DataFrame, key: str, vec_col: str, decimals: int | None = 6) -> DataFrame:
    """Element-wise mean vector per key.

    Exploding to (key, position) lets the partial aggregate combine map-side;
    only #keys x dim partial sums cross the shuffle.
    """
    ex = df.select(key, F.posexplode(vec_col).alias("pos", "v"))
    agg = ex.groupBy(key, "pos").agg(F.avg("v").alias("m"))
    m = F.round("m", decimals) if decimals is not None else F.col("m")
    return agg.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", m.alias("m")))).alias("_v")) \
        .select(key, F.transform("_v", lambda e: e["m"]).alias("mean_vector"))


# ------------------------------------------------------------------ E5
def embedding_dimension_check(df: DataFrame, cols: list[str]) -> DataFrame:
    """E5: per vector column the distinct sizes seen; valid when one size, equal across columns."""
    out = df.agg(*[F.count_distinct(F.size(c)).alias(f"{c}_n_dims") for c in cols],
                 *[F.max(F.size(c)).alias(f"{c}_dim") for c in cols],
                 F.count_if(F.greatest(*[F.size(c) for c in cols]) != F.least(*[F.size(c) for c in cols]))
                 .alias("rows_with_unequal_dims") if len(cols) > 1 else F.lit(0).alias("rows_with_unequal_dims"))
    return out
