"""Benchmark decontamination by a positional inverted index (operator 9); DataFrame functions only.

An item's windows are its runs of 10 words (a shorter item is one window).
Corpus counts of the items' terms give each window its two rarest terms.  The
postings (term, document, position) of those are stored for all documents.
Offset-adjusted, a posting lies on a diagonal: position in the document less
position in the item.  The lists of the rarest terms give the diagonals, those of
the second-rarest must meet them, and on what is left the lists of all the
item's terms are intersected; a run of matches as long as a window is an
occurrence of it, and words inside are hit.

Terms and documents are preselected by bitmaps of a bounded size, which let
more through when full and never hold back what they should let through;
joins decide.

Defined results: a null, empty or wordless text has no words and no hits; a
document row is known by its id and its text, so rows that repeat an id are
judged by their own text and equal rows alike; items without id or words are not searched; rows
of one item_id count as one item; an empty benchmark leaves all documents
clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bits import bitmap, may_hold, words_for
from .common import store, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; an empty list for none."""
    text = F.coalesce(text, F.lit(""))
    # lower() knows all scripts, so only plain ASCII texts may take it
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(low, SEPARATOR), lambda w: w != "")


def _words(df: DataFrame, text: str) -> DataFrame:
    """df with ``ws``.

    Refer to it once and explode it as outer: a second reference, or the size check that
    Spark infers below a plain explode, would split every text again.
    """
    return df.withColumn("ws", word_list(F.col(text)))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .withColumn("th", F.xxhash64("text"))


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text", window: int = 10) -> DataFrame:
    """(item, th, n, need, i, term): the words of each item with words and id."""
    base = items.select(F.col(key).alias("item"), F.col(text).alias("text")).filter("item is not null") \
        .withColumn("th", F.xxhash64("text"))
    return _words(base, "text").filter(F.size("ws") > 0).dropDuplicates(["item", "th"]) \
        .select("item", "th", F.size("ws").alias("n"), F.least(F.size("ws"), F.lit(window)).alias("need"),
                F.posexplode("ws").alias("i", "term"))


def postings(docs: DataFrame, terms: DataFrame, what: str, only: Column | None = None) -> DataFrame:
    """The stored index: (term, id, th, pos) of every occurrence of ``terms`` (one string column) in ``docs`` (id, text, th)."""
    n_words = words_for(terms.count())
    bits = bitmap(terms.select(F.xxhash64("term").alias("h")), n_words)
    if only is not None:
        docs = docs.filter(only)
    every = _words(docs, "text").select("id", "th", F.posexplode_outer("ws").alias("pos", "term"))
    return store(every.filter(may_hold(bits, F.xxhash64("term"))).join(terms, "term", "left_semi"), what)


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): occurrences in all documents of those ``terms`` that occur."""
    bits = bitmap(terms.select(F.xxhash64("term").alias("h")), words_for(terms.count()))
    every = _words(docs, "text").select(F.explode_outer("ws").alias("term"))
    return store(every.filter(may_hold(bits, F.xxhash64("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
                 .join(terms, "term", "left_semi"), "term-counts")


def _rarest(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, th, i, rank): per window the places of its rarest (1) and second-rarest (2) word.

    A window with a word that no document holds can't occur and has none.
    """
    known = terms.join(counts, "term", "left")
    # word i stands in the windows that start at i - need + 1 .. i
    wins = known.select("item", "th", "need", "n", "i", "term", "df", F.explode(
        F.sequence(F.greatest(F.col("i") - F.col("need") + 1, F.lit(0)), F.least("i", F.col("n") - F.col("need")))).alias("w"))
    by = Window.partitionBy("item", "th", "w")
    return wins.withColumn("lost", F.max(F.col("df").isNull()).over(by)).filter(~F.col("lost")) \
        .withColumn("rank", F.row_number().over(by.orderBy("df", "term", "i"))).filter("rank <= 2") \
        .select("item", "th", "i", "term", "rank", "need").distinct()


def phrase_runs(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                item_text: str = "text", window: int = 10) -> DataFrame:
    """Exact matches, stored: (id, th, item, first, last), runs of document words that are covered by the item's windows."""
    docs = _keyed(docs, key, text)
    terms = store(item_terms(items, item_key, item_text, window), "item-terms")
    rare = store(_rarest(terms, term_counts(docs, terms.select("term").distinct())), "rare-terms")
    index = postings(docs, rare.select("term").distinct(), "rare-postings")
    on = rare.withColumnRenamed("th", "ith").join(index, "term") \
        .select("item", "ith", "id", "th", (F.col("pos") - F.col("i")).alias("diagonal"), "i", "rank", "need")
    diagonals = store(on.groupBy("item", "ith", "id", "th", "diagonal")
                      .agg(F.min("rank").alias("rank"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.first("need").alias("need"))
                      .filter("rank = 1 and (lo < hi or need = 1)").select("item", "ith", "id", "th", "diagonal"), "diagonals")
    found = diagonals.select("id", "th").distinct()
    bits = bitmap(found.select(F.xxhash64("id", "th").alias("h")), words_for(found.count()))
    near = may_hold(bits, F.xxhash64("id", "th"))
    rest = postings(docs, terms.select("term").distinct(), "item-postings", near)
    wanted = diagonals.join(terms.withColumnRenamed("th", "ith"), ["item", "ith"]) \
        .select("item", "ith", "id", "th", "diagonal", "i", "need", "term", (F.col("diagonal") + F.col("i")).alias("pos"))
    met = wanted.join(rest, (wanted.id.eqNullSafe(rest.id)) & (wanted.th == rest.th) & (wanted.pos == rest.pos) & (wanted.term == rest.term), "left_semi")
    line = Window.partitionBy("item", "ith", "id", "th", "diagonal").orderBy("i")
    runs = met.distinct().withColumn("run", F.col("i") - F.row_number().over(line)) \
        .groupBy("item", "ith", "id", "th", "diagonal", "run") \
        .agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("need").alias("need")) \
        .filter("last - first + 1 >= need")
    return store(runs.select("id", "th", "item", "first", "last").distinct(), "phrase-runs")


def proximity_matches(docs: DataFrame, items: DataFrame, within: int = 20, key: str = "doc_id", text: str = "text",
                      item_key: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """(id, item, pos, other): the two rarest words of one of an item's windows at most ``within`` words apart, in any order.

    Positions are cut into cells of ``within`` words, and a posting meets only
    those of its own and the two adjoining cells.
    """
    docs = _keyed(docs, key, text)
    terms = store(item_terms(items, item_key, item_text, window), "item-terms")
    rare = _rarest(terms, term_counts(docs, terms.select("term").distinct())).select("item", "term", "rank").distinct()
    index = postings(docs, rare.select("term").distinct(), "rare-postings").withColumn("cell", F.floor(F.col("pos") / within))
    one = rare.filter("rank = 1").join(index, "term").select("item", "id", "th", "pos", "cell")
    two = rare.filter("rank = 2").join(index, "term").select("item", "id", "th", F.col("pos").alias("other"),
                                                             F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    return one.join(two, ["item", "id", "th", "cell"]).filter(F.abs(F.col("pos") - F.col("other")).between(1, within)) \
        .select("id", "item", "pos", "other").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", window: int = 10) -> DataFrame:
    """(id, th, n_words, n_hit, n_items, items) for every row of ``docs``; items: sorted as strings."""
    runs = phrase_runs(docs, items, key, text, item_key, item_text, window)
    before = Window.partitionBy("id", "th").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    covered = runs.select("id", "th", "first", "last").distinct() \
        .withColumn("seen", F.coalesce(F.max("last").over(before), F.lit(-1))) \
        .groupBy("id", "th").agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.col("seen") + 1) + 1)).alias("n_hit"))
    named = runs.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    hits = covered.join(named, covered.id.eqNullSafe(named.id) & (covered.th == named.th)) \
        .select(covered.id.alias("hid"), covered.th.alias("hth"), "n_hit", "items")
    base = _words(_keyed(docs, key, text), "text").select("id", "th", F.size("ws").cast("long").alias("n_words"))
    return base.join(hits, base.id.eqNullSafe(hits.hid) & (base.th == hits.hth), "left") \
        .select("id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLES = {"op9_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2),
    lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) AS s FROM b WHERE len(ws) > 0),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS p0, unnest(list_transform(range(1, len(ws) - n + 2),
    lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n),
occ AS (SELECT DISTINCT doc_id, item_id, p0, n FROM dw JOIN bw USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""}
