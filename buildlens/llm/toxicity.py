"""Toxicity by a factorization machine over hashed terms (operator 1).

A document's terms are the 40-bit hashes of its distinct words, A-Z lower-cased,
and further ones for words that it holds twice or more.  The
score is the logistic of ``bias + sum w[t] + sum over pairs <v[t], v[u]>``, so a
pair of terms weighs more or less than both alone.  It is fitted in
numpy on a bounded sample of labelled documents (``SAMPLE``; equal texts count
once).  A term takes part if enough of them hold it and either it goes with the
label beyond chance, or a pair that it belongs to does, beyond what both of its
terms do alone; such pairs are looked for in the labelled documents that the terms
of the first kind don't explain.  The model is broadcast; it holds terms of
the sample only.  Scoring reads every whole text in one pass without a shuffle.

Labels come only from rows that are not held out.  Defined results: null and
empty texts have no terms and get the score of the bias; documents without a
label are scored like others; a null label is no label; with no labelled rows
at all the score is 0 everywhere.  Rows that repeat a doc_id are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .spans import U64, blocks, mix, span_hashes
from .words import words

SAMPLE = 16_000      # labelled documents to fit on
MIN_DOCS = 4         # of the sample's documents that hold a term, at least, at every size of the sample
FACTORS = 4
BUCKETS = 1 << 22    # counters that pairs of terms are hashed into first
THRESHOLD = 0.3

#: ASCII characters that are neither letter nor digit.
MARKS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def document_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct term hashes of each row, rows' offsets in them)."""
    raw, off, starts, ends, row = words(texts, MARKS)
    key = span_hashes(raw, starts, ends) >> U64(24)
    key, row = _distinct(key, row)
    return key, np.searchsorted(row, np.arange(len(off)))


def _distinct(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, and, as terms of their own, those that the row holds twice or more."""
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    second = np.zeros(len(key), bool)
    second[1:] = ~fresh[1:] & fresh[:-1]
    key = np.concatenate([key[fresh], mix(key[second] + U64(1)) >> U64(24)])
    row = np.concatenate([row[fresh], row[second]])
    order = np.lexsort((key, row))
    return key[order], row[order]


class FactorizationMachine:
    def __init__(self, terms: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.terms, self.bias, self.w, self.v = terms, bias, w, v

    def scores(self, keys: np.ndarray, off: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.terms, keys)
        place[place == len(self.terms)] = 0
        known = self.terms[place] == keys if len(self.terms) else np.zeros(len(keys), bool)
        upto = np.concatenate([[0], np.cumsum(known)])
        return _logistic(_forward(place[known], upto[off], self.bias, self.w, self.v)[0])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _forward(idx, off, bias, w, v):
    own = v[idx]
    line, square = _sums(own, off), _sums((own * own).sum(axis=1), off)
    return bias + _sums(w[idx], off) + 0.5 * ((line * line).sum(axis=1) - square), line, own


def _beyond_chance(ones: np.ndarray, many: np.ndarray, share) -> np.ndarray:
    """Of counts of labelled ones among many: what is beyond 6 standard deviations and 3 documents of a share."""
    return ones - many * share - 6 * np.sqrt(many * share * (1 - share)) - 3


def fit(docs: list[np.ndarray], labels: np.ndarray, rounds: int = 600, factors: int = FACTORS, seed: int = 7) -> FactorizationMachine:
    """Fit on term lists and 0/1 labels.

    A term takes part if its documents have more (or fewer) ones than chance
    explains, by 6 standard deviations and 3 documents, so words of unrelated
    texts have no weight.  Then the terms of ``_telling_pairs`` join, and all is fitted anew.
    """
    if not docs:
        return FactorizationMachine(np.zeros(0, U64), -40.0, np.zeros(0), np.zeros((0, factors)))
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    every, which, many = np.unique(np.concatenate(docs), return_inverse=True, return_counts=True)
    off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    ones = np.bincount(which, np.repeat(labels, np.diff(off)), len(every))
    enough = many >= min(MIN_DOCS, len(docs))
    alone = enough & (np.maximum(_beyond_chance(ones, many, share), _beyond_chance(many - ones, many, 1 - share)) > 0)
    model = _descend(docs, labels, every[alone], share, rounds, factors, seed)
    idx, cut = _places(docs, model.terms)
    missed = np.flatnonzero((labels == 1) & (_logistic(_forward(idx, cut, model.bias, model.w, model.v)[0]) < 0.5))
    pairs = _telling_pairs(which, off, labels, missed, enough, np.maximum(ones / many, share))
    joined = alone.copy()
    joined[pairs.ravel()] = True
    return _descend(docs, labels, every[joined], share, rounds, factors, seed) if len(pairs) else model


def _telling_pairs(term: np.ndarray, off: np.ndarray, labels: np.ndarray, missed: np.ndarray, enough: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Pairs of terms (rows of two) whose common documents have more ones than the higher ``rate`` of the two explains.

    ``term``: places of the documents' terms, tiled by ``off``.  Only pairs that ``MIN_DOCS`` of the ``missed``
    documents hold can tell; they are counted in hashed counters first, then exactly.
    """
    lists = [np.unique(term[off[d]:off[d + 1]]) for d in missed]
    count = np.bincount(np.concatenate(lists or [np.zeros(0, np.int64)]), minlength=len(enough))
    usable = enough & (count >= MIN_DOCS)
    lists = [x[usable[x]] for x in lists]
    n = U64(len(enough))

    def keys(x: np.ndarray):
        for i in range(0, len(x), 512):  # some thousand rows of the triangle at a time
            a, b = np.nonzero(np.arange(i, min(i + 512, len(x)))[:, None] < np.arange(len(x)))
            yield x[a + i].astype(U64) * n + x[b].astype(U64)

    tally = np.zeros(BUCKETS, np.uint16)
    for x in lists:
        for k in keys(x):
            np.add.at(tally, (mix(k) % U64(BUCKETS)).astype(np.int64), 1)
    held = [k[tally[(mix(k) % U64(BUCKETS)).astype(np.int64)] >= MIN_DOCS] for x in lists for k in keys(x)]
    pair, often = np.unique(np.concatenate(held or [np.zeros(0, U64)]), return_counts=True)
    pair = pair[often >= MIN_DOCS]
    a, b = (pair // n).astype(np.int64), (pair % n).astype(np.int64)
    # the documents of each term that is in a pair
    used = np.zeros(len(enough), bool)
    used[a] = used[b] = True
    hit = np.flatnonzero(used[term])
    doc = np.searchsorted(off, hit, side="right") - 1
    order = np.lexsort((doc, term[hit]))
    doc, own = doc[order], term[hit][order]
    where = lambda t: doc[np.searchsorted(own, t, "left"):np.searchsorted(own, t, "right")]
    good = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        both = np.intersect1d(where(i), where(j))
        if _beyond_chance(labels[both].sum(), len(both), min(max(rate[i], rate[j]), 1 - 1e-3)) > 0:
            good.append((i, j))
    return np.array(good, np.int64).reshape(-1, 2)


def _descend(docs: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, share: float, rounds: int, factors: int, seed: int) -> FactorizationMachine:
    """Weights and factors of ``terms`` (ascending), fitted together on all documents at once; a step is divided by the
    number of terms that a document brings, which keeps simultaneous steps from overshooting."""
    bias = float(np.log(share / (1 - share)))
    w, v = np.zeros(len(terms)), np.random.default_rng(seed).normal(0, 0.05, (len(terms), factors))
    idx, off = _places(docs, terms)
    size = np.diff(off)
    row, gv = np.repeat(np.arange(len(docs)), size), np.full(v.shape, 1.0)
    for _ in range(rounds if len(terms) else 0):
        out, line, own = _forward(idx, off, bias, w, v)
        p = _logistic(out)
        steep = np.maximum(p * (1 - p), 0.02)
        error = (p - labels)[row]
        dv = np.stack([np.bincount(idx, error * (line[row, f] - own[:, f]), len(terms)) for f in range(factors)], axis=1) + 0.05 * v
        gv += dv * dv
        w = w - (np.bincount(idx, error, len(terms)) + 0.1 * w) / (np.bincount(idx, (steep * (1 + size))[row], len(terms)) + 0.1)
        v = v - 0.05 * dv / np.sqrt(gv)
        bias -= float((p - labels).sum() / (steep * (1 + size)).sum())
    return FactorizationMachine(terms, bias, w, v)


def _places(docs: list[np.ndarray], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``terms`` of all documents' terms, the documents' offsets in them)."""
    lists = []
    for d in docs:
        place = np.minimum(np.searchsorted(terms, d), max(len(terms) - 1, 0))
        lists.append(place[terms[place] == d] if len(terms) else place[:0])
    return np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          sample: int = SAMPLE) -> FactorizationMachine:
    """Fit on ``sample`` labelled documents at most, the ones whose ids hash lowest among those not held out."""
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).filter(~held_out("id") & F.col("y").isin(0, 1))
    chosen = known.orderBy(F.xxhash64("id", F.lit("toxicity")), "id", "y").limit(sample)

    def scan(batches):
        for batch in batches:
            for at, part in blocks(batch.column(0)):
                keys, off = document_terms(part)
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(at, len(part)), batch.column(2).slice(at, len(part)),
                    pa.array([keys[a:b].tobytes() for a, b in zip(off, off[1:], strict=False)], pa.binary())], ["h", "y", "terms"])

    # the sample's ids are few by its bound, so the texts stay where they are
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id") \
        .select("text", F.xxhash64("text").alias("h"), "y").mapInArrow(scan, "h long, y int, terms binary").collect()
    once = {(r["h"], r["y"]): r["terms"] for r in sorted(rows, key=lambda r: (r["h"], r["y"]))}
    return fit([np.frombuffer(t, U64) for t in once.values()], np.array([y for _, y in once], float))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of ``text``; replaces a column of that name."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms of a bounded sample
    kept = [f for f in docs.schema.fields if f.name != score]
    names = [f.name for f in kept]

    def scan(batches):
        for batch in batches:
            for at, part in blocks(batch.column(text)):
                made = shared.value.scores(*document_terms(part))
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(at, len(part)) for n in names), pa.array(made)], [*names, score])

    return docs.select(*(f"`{n}`" for n in names)).mapInArrow(scan, T.StructType([*kept, T.StructField(score, T.DoubleType())]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
