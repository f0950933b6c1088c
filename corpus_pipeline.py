"""A corpus pipeline of five stages, each one of the operators of ``buildlens.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.

1. language: documents without a language (null, no letter, or a best score
   below ``MIN_SCORE``) go.
2. lines: repeated lines are dropped from texts; n_chars follows.  A document
   that is left empty stays.
3. near_duplicates: of each group of similar documents the one with the lowest doc_id
   stays; documents without words and lone documents stay.
4. decontamination: documents that hold a window of a benchmark item go.
5. tokens: ids by the rank file, with their digests and those of the decoded bytes.

A row without doc_id passes the stages like any other and counts as clean of
duplicates if its group has no id at all; rows that repeat an id share its fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm import byte_bpe, decontaminate, language, line_dedup, ngram_join
from buildlens.llm.common import store, table

MIN_SCORE = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The byte network has no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = language.identify(docs.select(*COLUMNS), language.train(docs))
    return scored.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = ngram_join.similar_documents(docs.select("doc_id", "text")).filter(F.col("id").eqNullSafe(F.col("component_id"))).select("id").distinct()
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hit = decontaminate.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select("id", "th").distinct()
    keyed = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("__th"))
    return keyed.join(hit, keyed.doc_id.eqNullSafe(hit.id) & (keyed["__th"] == hit.th), "left_anti").select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(docs)


STAGES = [("language", by_language), ("lines", without_repeated_lines), ("near_duplicates", without_near_duplicates),
          ("decontamination", without_benchmark), ("tokens", to_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = store(docs, f"stage-{name}")
    return docs
