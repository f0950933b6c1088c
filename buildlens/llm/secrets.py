"""Secret scan with a battery of randomness tests (operator 2); DataFrame functions only.

Base spans are matches of three patterns.  Further candidates are long tokens of
the usual encodings.  For each, by the encoding that its characters allow:

* as a random string: a chi-squared test of a uniform alphabet, a runs test on
  the alphabet's halves and a serial correlation of neighbouring symbols, none
  of which may reject;
* as text: how far it has fewer equal pairs of characters and more changes
  between digits, lower and upper case than text has, as Chernoff bounds of the
  two tails, joined by Fisher's rule.  Both bounds get sharp with the length, so
  a short token proves little.

False discoveries are controlled at rate ``FDR`` in every stratum of encoding and
length octave apart, over all candidates of the corpus (Benjamini-Hochberg on a
histogram of log p).  Discoveries become spans of kind ``random``.

Positions come from the lengths of the pieces between matches, summed by a
window over one document's matches.  Tokens of any length are tested whole, in time that
grows with the length.  Defined results: a null text is ''; a row
is known by id and text, so rows that repeat both have equal results; an empty
table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store, table

#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

SYMBOL = "[A-Za-z0-9+/_=-]"
#: Tokens of 20 symbols with a digit, or of 40: others can't prove anything.
TOKEN = f"(?<!{SYMBOL})(?:(?=[A-Za-z+/_=-]*[0-9]){SYMBOL}{{20,}}|{SYMBOL}{{40,}})"
KINDS = ("assign", "access", "hex", "random")
FDR = 0.01
TEXT_PAIRS, TEXT_CHANGES = 0.066, 0.12  # of text: share of equal character pairs, of changes between classes
BINS, STEP = 1200, 0.05                 # histogram of -log10 p

#: Alphabets by encoding, in order of preference.
ENCODINGS = (("digits", "^[0-9]+$", 10), ("hex", "^([0-9a-f]+|[0-9A-F]+)$", 16), ("lower", "^[a-z]+$", 26), ("upper", "^[A-Z]+$", 26),
             ("base32", "^[A-Z2-7]+$", 32), ("base36", "^([a-z0-9]+|[A-Z0-9]+)$", 36), ("base62", "^[A-Za-z0-9]+$", 62),
             ("base64", "^[A-Za-z0-9+/]+$", 64), ("base64url", "^[A-Za-z0-9_-]+$", 64))


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored matches of all patterns: (id, th, kind, start, end, match); code points, end exclusive."""
    # a run of 32 or an access key of 16 may be asked for outright: a shorter run can't hold a longer one
    patterns = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}", "random": TOKEN}
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("id"), body.alias("text"))
    found = [F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("kind"), F.transform(F.split("text", p, -1), F.char_length).alias("gap"),
                                                      F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("match")))
             for k, p in patterns.items()]
    rows = base.select("id", F.xxhash64("text").alias("th"), F.explode(F.array(*found)).alias("hit")).filter("hit is not null") \
        .select("id", "th", "hit.kind", F.posexplode(F.arrays_zip("hit.gap", "hit.match")).alias("n", "piece")) \
        .select("id", "th", "kind", "n", F.col("piece")["gap"].alias("gap"), F.col("piece")["match"].alias("match")).filter("match is not null")
    rows = store(rows, "secret-matches").dropDuplicates(["id", "th", "kind", "n"])
    size = F.char_length("match")
    before = Window.partitionBy("id", "th", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end", F.sum(F.col("gap") + size).over(before)) \
        .select("id", "th", "kind", (F.col("end") - size).alias("start"), "end", "match")


def _holds(kind: Column, match: Column) -> Column:
    size = F.when(kind == "assign", F.char_length(F.regexp_extract(match, ASSIGN, 2))).otherwise(F.char_length(match))
    return F.when(kind == "assign", size >= LEAST["assign"]).when(kind == "access", size >= LEAST["access"]).when(kind == "hex", size >= LEAST["hex"]).otherwise(True)


def _tail(bad: Column, bound: Column) -> Column:
    """log of a Chernoff bound, 0 where the value is on the side of text."""
    return F.when(bad, F.lit(0.0)).otherwise(F.least(bound, F.lit(0.0)))


def randomness(tokens: DataFrame, token: str = "match") -> DataFrame:
    """``tokens`` with encoding, octave, passes (the three tests don't reject) and logp (natural log, as text).

    What a later expression reads per character is stored first: else it would be made anew for every
    character, and the cost of a token would grow with the square of its length and more.
    """
    t = F.regexp_replace(F.col(token), "=+$", "")
    df = tokens.withColumn("t", t).withColumn("n", F.char_length("t").cast("double")).filter("n >= 16")
    encoding, letters = F.lit("mixed"), F.lit(66)
    for name, pattern, size in reversed(ENCODINGS):
        encoding = F.when(F.col("t").rlike(pattern), F.lit(name)).otherwise(encoding)
        letters = F.when(F.col("t").rlike(pattern), F.lit(size)).otherwise(letters)
    chars = F.split("t", "")
    df = store(df.withColumn("encoding", encoding).withColumn("letters", letters.cast("double"))
               .withColumn("symbols", F.array_distinct(chars)).withColumn("codes", F.transform(chars, F.ascii)), "token-codes")
    squares = F.aggregate("symbols", F.lit(0.0), lambda a, c: a + F.pow(F.col("n") - F.char_length(F.replace("t", c, F.lit(""))), 2))
    # the token's own middle code parts its lower from its upper half
    df = store(df.withColumn("squares", squares).withColumn("middle", F.element_at(F.array_sort("codes"), (F.col("n") / 2).cast("int") + 1)), "token-counts")
    # chi-squared by the Wilson-Hilferty cube root
    free = F.col("letters") - 1
    chi = F.col("letters") / F.col("n") * F.col("squares") - F.col("n")
    z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    # runs of the lower and the upper half of the characters
    df = df.withColumn("side", F.array_join(F.transform("codes", lambda c: F.when(c < F.col("middle"), "0").otherwise("1")), ""))
    ones = F.char_length(F.replace("side", F.lit("0"), F.lit(""))).cast("double")
    runs = F.char_length(F.regexp_replace("side", "(.)\\1*+", "$1")).cast("double")
    mean = 2 * ones * (F.col("n") - ones) / F.col("n") + 1
    z_runs = (runs - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (F.col("n") - 1), F.lit(1e-9)))
    # serial correlation of neighbours
    codes, n = F.col("codes"), F.col("n")
    total = lambda f: F.aggregate(codes, F.lit(0.0), lambda a, c: a + f(c))
    lag = F.aggregate(F.zip_with(codes, F.slice(codes, 2, F.size(codes)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    first, last = F.element_at(codes, 1).cast("double"), F.element_at(codes, -1).cast("double")
    df = df.withColumn("sum1", total(lambda c: c)).withColumn("sum2", total(lambda c: c.cast("double") * c)).withColumn("lag", lag)
    s1, s2 = F.col("sum1"), F.col("sum2")
    middle = s1 / n
    covariance = F.col("lag") - middle * (2 * s1 - first - last) + (n - 1) * middle * middle
    spread = F.greatest(s2 - s1 * middle, F.lit(1e-9))
    z_serial = (covariance / spread + 1 / n) * F.sqrt(n)
    # as text: few equal pairs, many changes of class
    expected = F.lit(TEXT_PAIRS) * n * (n - 1) / 2
    equal = (F.col("squares") - n) / 2
    few = _tail(equal >= expected, equal - expected - F.when(equal > 0, equal * F.log(equal / expected)).otherwise(0.0))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("t", "[^A-Za-z0-9]", ""), "[0-9]++", "0"), "[a-z]++", "a"), "[A-Z]++", "A")
    places = F.greatest(F.char_length(F.regexp_replace("t", "[^A-Za-z0-9]", "")) - 1, F.lit(1)).cast("double")
    share = F.greatest(F.char_length(classes) - 1, F.lit(0)).cast("double") / places
    part = lambda x, p: F.when(x > 0, x * F.log(x / p)).otherwise(0.0)
    many = _tail(share <= TEXT_CHANGES, -places * (part(share, F.lit(TEXT_CHANGES)) + part(1 - share, F.lit(1 - TEXT_CHANGES))))
    both = -(few + many)
    return df.withColumn("passes", (z_chi < 3.1) & (F.abs(z_runs) < 3.3) & (F.abs(z_serial) < 3.3)) \
        .withColumn("logp", F.log1p(both) - both).withColumn("octave", F.floor(F.log2("n")).cast("int")) \
        .drop("t", "n", "letters", "symbols", "codes", "squares", "middle", "side", "sum1", "sum2", "lag")


def discoveries(tested: DataFrame, rate: float = FDR) -> DataFrame:
    """Rows of ``randomness`` that the false-discovery control keeps, per stratum of encoding and octave."""
    where = F.least(F.floor(-F.col("logp") / (math.log(10) * STEP)), F.lit(BINS - 1)).cast("int")
    bars: dict[tuple, float] = {}
    tally: dict[tuple, dict[int, int]] = {}
    for r in tested.groupBy("encoding", "octave", where.alias("bin")).count().collect():  # strata x BINS at most
        tally.setdefault((r["encoding"], r["octave"]), {})[r["bin"]] = r["count"]
    for stratum, bins in tally.items():
        total, above = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if 10 ** (-b * STEP) * total <= rate * above:
                bars[stratum] = b
    if not bars:
        return tested.limit(0)
    bar = F.create_map(*(F.lit(x) for (e, o), b in sorted(bars.items()) for x in (f"{e} {o}", b)))
    return tested.filter(F.col("passes") & (where >= F.try_element_at(bar, F.concat_ws(" ", "encoding", F.col("octave").cast("string")))))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = FDR) -> DataFrame:
    """All spans: (id, th, kind, start, end, match); th is the hash of the row's text."""
    every = matches(docs, key, text)
    base = every.filter("kind <> 'random'").filter(_holds(F.col("kind"), F.col("match")))
    tested = store(randomness(every.filter("kind = 'random'")), "tested-tokens")
    return base.unionByName(discoveries(tested, rate).select(*base.columns))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    label = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    spans = find_secrets(docs).withColumn("span", F.struct("start", rank.alias("rank"), "end", label.alias("label"))) \
        .groupBy("id", "th").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS), F.array_sort(F.collect_list("span")).alias("spans"))
    joined = lambda a: F.array_join(F.transform(a, lambda s: s["label"]), ",")
    spans = spans.withColumn("base", F.filter("spans", lambda s: s["rank"] <= 3)) \
        .select("id", "th", *(f"n_{k}" for k in KINDS), joined(F.col("base")).alias("base"), joined(F.col("spans")).alias("spans"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("rh"))
    return rows.join(spans, rows.doc_id.eqNullSafe(spans.id) & (rows.rh == spans.th), "left").select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_random", F.lit(0)).cast("long").alias("n_random"))


QUERIES = {"op2_secrets": op2_secrets}
ORACLES: dict[str, str] = {}
