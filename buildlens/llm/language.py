"""Language identification by a byte convolutional network (operator 8).

Lower-cased text is cut into windows of ``WINDOW`` bytes.  Filters of several
widths slide over byte embeddings, each keeps its largest response in the
window, and a softmax over those gives the window's language.  A filter over
embeddings is a sum of one table row per byte and place, so windows are scored
in batches by table look-ups.  A document's probabilities are the mean of its
windows', weighted by their bytes; every window of the whole text counts.

The network is trained in numpy (Adam) on a bounded sample: ``SAMPLE`` documents
of each language at most, fewer where ``TOTAL`` documents divided among all languages
are fewer (one at least), and ``SPREAD`` windows of each.  Every language takes part.  Only rows that are not held out and have a language are used.

Defined results: a null text, or one without any letter, is ``und`` with score
0; so is everything when no language could be learned; repeated rows are
predicted alike; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table, tidy
from .spans import LETTER, blocks, char_classes, code_points, utf8

WINDOW, BATCH = 128, 256
SAMPLE, SPREAD, TOTAL = 500, 5, 32_000
WIDTHS, FILTERS, EMBED = (2, 3, 4), 24, 12


def windows(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of bytes padded by 0, row of each, bytes of each)."""
    size = np.diff(off)
    many = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), many)
    begin = (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)) * WINDOW
    length = np.minimum(WINDOW, size[row] - begin)
    at = off[:-1][row] + begin
    padded = np.concatenate([raw, np.zeros(WINDOW, np.uint8)])
    out = padded[at[:, None] + np.arange(WINDOW)]
    out[np.arange(WINDOW) >= length[:, None]] = 0
    return out, row, length


class ByteNetwork:
    def __init__(self, langs: list[str], embed: np.ndarray, filters: list[np.ndarray], bias: list[np.ndarray],
                 out: np.ndarray, out_bias: np.ndarray):
        self.langs, self.embed, self.filters, self.bias, self.out, self.out_bias = langs, embed, filters, bias, out, out_bias

    @classmethod
    def new(cls, langs: list[str], seed: int = 11) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        return cls(langs, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
                   [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
                   [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                   rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))

    def tables(self) -> list[np.ndarray]:
        """Per width and place: response of each filter to each byte."""
        return [np.einsum("be,wef->wbf", self.embed, f) for f in self.filters]

    def pooled(self, x: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of every filter in every window, and where it is."""
        best, spots = [], []
        for w, t, b in zip(WIDTHS, tables, self.bias, strict=True):
            n = x.shape[1] - w + 1
            total = t[0][x[:, :n]]
            for j in range(1, w):
                total += t[j][x[:, j:n + j]]
            spot = total.argmax(axis=1)
            best.append(np.take_along_axis(total, spot[:, None], axis=1)[:, 0] + b)
            spots.append(spot)
        return np.concatenate(best, axis=1), spots

    def largest(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        best = []
        for w, t, b in zip(WIDTHS, tables, self.bias, strict=True):
            n = x.shape[1] - w + 1
            total = t[0][x[:, :n]]
            for j in range(1, w):
                total += t[j][x[:, j:n + j]]
            best.append(total.max(axis=1) + b)
        return np.concatenate(best, axis=1)

    def probabilities(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        return _softmax(np.maximum(self.largest(x, tables), 0) @ self.out + self.out_bias)

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in langs, score) of each row; rows without bytes get place 0."""
        tables, total = self.tables(), np.zeros((len(off) - 1, len(self.langs)))
        x, row, length = windows(raw, off)
        for at in range(0, len(x), BATCH):
            p = self.probabilities(x[at:at + BATCH], tables) * length[at:at + BATCH, None]
            for k in range(total.shape[1]):
                total[:, k] += np.bincount(row[at:at + BATCH], p[:, k], len(total))
        best = total.argmax(axis=1)
        return best, np.clip(total[np.arange(len(total)), best] / np.maximum(np.diff(off), 1), 0, 1)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 3) -> None:
        rng, params = np.random.default_rng(seed), [self.embed, *self.filters, *self.bias, self.out, self.out_bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                step += 1
                for p, g, m, s in zip(params, self._gradients(x[some], y[some]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        best, spots = self.pooled(x, self.tables())
        act = np.maximum(best, 0)
        delta = _softmax(act @ self.out + self.out_bias)
        delta[np.arange(len(y)), y] -= 1
        delta /= len(y)
        back = (delta @ self.out.T) * (best > 0)
        d_embed, d_filters, d_bias = np.zeros_like(self.embed), [], []
        for i, w in enumerate(WIDTHS):
            part, line = back[:, i * FILTERS:(i + 1) * FILTERS], np.arange(len(x))[:, None]
            grad = np.zeros_like(self.filters[i])
            for j in range(w):
                byte = x[line, spots[i] + j]  # the byte that each filter's best place saw
                grad[j] = np.einsum("nf,nfe->ef", part, self.embed[byte])
                flow = (part[:, :, None] * self.filters[i][j].T[None]).reshape(-1, EMBED)
                np.add.at(d_embed, byte.ravel(), flow)
            d_filters.append(grad)
            d_bias.append(part.sum(axis=0))
        return [d_embed, *d_filters, *d_bias, act.T @ delta, delta.sum(axis=0)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _lowered(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pc.utf8_lower(part))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> ByteNetwork | None:
    """A network for the languages of rows that are not held out; None where there is none."""
    known = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")) \
        .filter(~held_out("id") & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return None
    sample = max(1, min(sample, TOTAL // len(counts)))
    # every language's rows are thinned to about ``sample``, by a hash of the row; 20 more leave none without
    share = docs.sparkSession.createDataFrame(pa.table({  # as Arrow: from a list it would start a second set of workers
        "lang": pa.array([r["lang"] for r in counts], pa.string()),
        "share": pa.array([min(1.0, (1.3 * sample + 20) / r["count"]) for r in counts], pa.float64())}))
    roll = F.pmod(F.xxhash64("text", "id", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)

    @tidy
    def scan(batches):
        for batch in batches:
            for at, part in blocks(batch.column(0)):
                x, row, _ = windows(*_lowered(part))
                begin = np.searchsorted(row, np.arange(len(part) + 1))
                pick = [np.unique(np.linspace(a, b - 1, SPREAD).astype(int)) if b > a else np.zeros(0, int) for a, b in zip(begin, begin[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(part)), batch.column(2).slice(at, len(part)),
                                                  pa.array([x[p].tobytes() for p in pick], pa.binary())], ["lang", "roll", "windows"])

    rows = known.withColumn("roll", roll).join(F.broadcast(share), "lang").filter("roll < share") \
        .select("text", "lang", "roll").mapInArrow(scan, "lang string, roll double, windows binary").collect()
    held: dict[str, list] = {}
    for r in rows:
        held.setdefault(r["lang"], []).append(r)
    langs = sorted(held)
    xs, ys = [], []
    for k, name in enumerate(langs):
        for r in sorted(held[name], key=lambda r: (r["roll"], r["windows"]))[:sample]:
            x = np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW)
            xs.append(x)
            ys.append(np.full(len(x), k))
    if not xs:
        return None
    net = ByteNetwork.new(langs)
    net.train(np.concatenate(xs), np.concatenate(ys))
    return net


def identify(docs: DataFrame, net: ByteNetwork | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; replaces columns of these names."""
    from pyspark.sql import types as T

    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in kept]
    slim = docs.select(*(f"`{n}`" for n in names))
    if net is None:
        return slim.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few tens of kB

    @tidy
    def scan(batches):
        for batch in batches:
            for at, part in blocks(batch.column(text)):
                _, units, off = code_points(part)
                letters = np.concatenate([[0], np.cumsum(char_classes()[units] == LETTER)])
                some = letters[off[1:]] > letters[off[:-1]]
                best, score = shared.value.predict(*_lowered(part))
                known = np.array(shared.value.langs, object)[best]
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(n).slice(at, len(part)) for n in names),
                    pa.array(np.where(some, known, "und"), pa.string()), pa.array(np.where(some, score, 0.0))], [*names, "lang_pred", "score"])

    return slim.mapInArrow(scan, T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language": op8_language}
ORACLES: dict[str, str] = {}
