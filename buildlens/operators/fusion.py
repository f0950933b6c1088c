"""Attention-fusion classifier on Spark.

The model is small (tens of thousands of weights); the data is not.  Scoring
is an Arrow ``mapInPandas`` over the sample table with the weights
broadcast.  Training is synchronous data-parallel gradient descent: every
step, each partition computes the summed gradient of its rows in numpy, the
per-partition gradients are tree-reduced, and the driver applies one AdamW
update to the small weight vector and re-broadcasts it.

Layer layout per modality: linear -> layer norm -> ReLU -> dropout; the
attention scorer is linear -> tanh -> linear (one score per modality);
softmax over the three; weighted sum; classifier linear -> ReLU -> dropout ->
linear -> logit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .diffs import materialize
from .forest import EmptySplitError

MODALITIES = ("message_embedding", "diff_embedding", "context_embedding")
LN_EPS = 1e-5
BLOCK = 1024  # rows of one numpy pass: its arrays are a few kB a row, and a batch holds up to 10,000 rows


@dataclass
class FusionConfig:
    embedding_dim: int
    model_dim: int = 128
    attention_dim: int = 64
    classifier_hidden_dim: int = 128
    dropout: float = 0.2
    separate_projections: bool = True

    def validate(self) -> None:
        sizes = {k: getattr(self, k) for k in ("embedding_dim", "model_dim", "attention_dim", "classifier_hidden_dim")}
        wrong = {k: v for k, v in sizes.items() if not v > 0}
        if wrong or not 0.0 <= self.dropout < 1.0:
            raise ValueError(f"sizes must be positive and dropout in [0, 1): {wrong or self.dropout}")


def _proj_names(cfg: FusionConfig) -> list[str]:
    return ["message", "diff", "context"] if cfg.separate_projections else ["shared"]


def hashed_uniform(seed: int, name: str, shape: tuple, bound: float) -> np.ndarray:
    """Deterministic Uniform(-bound, bound) weights: u = first 8 hex digits of
    md5("seed:name:i[:j]") / 2^32, w = (2u - 1) * bound.  Reproducible anywhere md5 is."""
    import hashlib
    out = np.empty(shape, dtype=np.float64)
    for idx in np.ndindex(*shape):
        key = ":".join([str(seed), name] + [str(i) for i in idx])
        u = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 4294967296.0
        out[idx] = (u * 2.0 - 1.0) * bound
    return out


def init_params(cfg: FusionConfig, seed: int = 0) -> dict[str, np.ndarray]:
    """Uniform(+-1/sqrt(fan_in)) linear weights (md5-seeded, see ``hashed_uniform``),
    unit layer-norm gains and zero shifts."""
    cfg.validate()

    def lin(name, out_dim, in_dim):
        k = 1.0 / np.sqrt(in_dim)
        return (hashed_uniform(seed, f"{name}.W", (out_dim, in_dim), k),
                hashed_uniform(seed, f"{name}.b", (out_dim,), k))

    p: dict[str, np.ndarray] = {}
    for name in _proj_names(cfg):
        p[f"{name}.W"], p[f"{name}.b"] = lin(name, cfg.model_dim, cfg.embedding_dim)
        p[f"{name}.g"] = np.ones(cfg.model_dim)
        p[f"{name}.beta"] = np.zeros(cfg.model_dim)
    p["att.W1"], p["att.b1"] = lin("att1", cfg.attention_dim, cfg.model_dim)
    w2, b2 = lin("att2", 1, cfg.attention_dim)
    p["att.w2"], p["att.b2"] = w2[0], b2
    p["cls.W1"], p["cls.b1"] = lin("cls1", cfg.classifier_hidden_dim, cfg.model_dim)
    c2, c2b = lin("cls2", 1, cfg.classifier_hidden_dim)
    p["cls.w2"], p["cls.b2"] = c2[0], c2b
    return p


# ------------------------------------------------------------------ forward / backward (numpy)
def _forward(p, cfg: FusionConfig, xs: list[np.ndarray], rng: np.random.Generator | None):
    names = _proj_names(cfg)
    keep = 1.0 - cfg.dropout
    cache = {"proj": []}
    hs = []
    for k, x in enumerate(xs):
        n = names[k] if cfg.separate_projections else names[0]
        z = x @ p[f"{n}.W"].T + p[f"{n}.b"]
        mu = z.mean(axis=1, keepdims=True)
        var = z.var(axis=1, keepdims=True)
        inv = 1.0 / np.sqrt(var + LN_EPS)
        zn = (z - mu) * inv
        ln = zn * p[f"{n}.g"] + p[f"{n}.beta"]
        h = np.maximum(ln, 0.0)
        mask = None
        if rng is not None and cfg.dropout > 0:
            mask = (rng.random(h.shape) < keep) / keep
            h = h * mask
        hs.append(h)
        cache["proj"].append((n, x, zn, inv, ln, mask))
    m = np.stack(hs, axis=1)                                # B x 3 x D
    a = np.tanh(m @ p["att.W1"].T + p["att.b1"])            # B x 3 x A
    s = a @ p["att.w2"] + p["att.b2"][0]                    # B x 3
    s = s - s.max(axis=1, keepdims=True)
    alpha = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
    fused = (alpha[:, :, None] * m).sum(axis=1)             # B x D
    qpre = fused @ p["cls.W1"].T + p["cls.b1"]
    q = np.maximum(qpre, 0.0)
    qmask = None
    if rng is not None and cfg.dropout > 0:
        qmask = (rng.random(q.shape) < keep) / keep
        q = q * qmask
    logit = q @ p["cls.w2"] + p["cls.b2"][0]
    cache.update(m=m, a=a, alpha=alpha, fused=fused, qpre=qpre, q=q, qmask=qmask)
    return logit, alpha, cache


def _backward(p, cfg: FusionConfig, cache, dlogit: np.ndarray) -> dict[str, np.ndarray]:
    g = {k: np.zeros_like(v) for k, v in p.items()}
    q, qpre, fused, m, a, alpha = (cache[k] for k in ("q", "qpre", "fused", "m", "a", "alpha"))
    g["cls.w2"] += q.T @ dlogit
    g["cls.b2"] += dlogit.sum()
    dq = np.outer(dlogit, p["cls.w2"])
    if cache["qmask"] is not None:
        dq = dq * cache["qmask"]
    dqpre = dq * (qpre > 0)
    g["cls.W1"] += dqpre.T @ fused
    g["cls.b1"] += dqpre.sum(axis=0)
    dfused = dqpre @ p["cls.W1"]
    dm = alpha[:, :, None] * dfused[:, None, :]
    dalpha = np.einsum("bkd,bd->bk", m, dfused)
    ds = alpha * (dalpha - (alpha * dalpha).sum(axis=1, keepdims=True))
    g["att.w2"] += np.einsum("bk,bka->a", ds, a)
    g["att.b2"] += ds.sum()
    dp = ds[:, :, None] * p["att.w2"][None, None, :] * (1.0 - a * a)
    g["att.W1"] += np.einsum("bka,bkd->ad", dp, m)
    g["att.b1"] += dp.sum(axis=(0, 1))
    dm = dm + dp @ p["att.W1"]
    for k, (n, x, zn, inv, ln, mask) in enumerate(cache["proj"]):
        dh = dm[:, k, :]
        if mask is not None:
            dh = dh * mask
        dln = dh * (ln > 0)
        g[f"{n}.g"] += (dln * zn).sum(axis=0)
        g[f"{n}.beta"] += dln.sum(axis=0)
        dzn = dln * p[f"{n}.g"]
        dz = inv * (dzn - dzn.mean(axis=1, keepdims=True) - zn * (dzn * zn).mean(axis=1, keepdims=True))
        g[f"{n}.W"] += dz.T @ x
        g[f"{n}.b"] += dz.sum(axis=0)
    return g


def _bce(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(logit, 0) - logit * y + np.log1p(np.exp(-np.abs(logit)))


def _inputs(pdf: pd.DataFrame, cols=MODALITIES) -> list[np.ndarray]:
    return [np.stack(pdf[c].to_numpy()).astype(np.float64) for c in cols]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of ``batches``, at most ``BLOCK`` at a time."""
    for pdf in batches:
        for first in range(0, len(pdf), BLOCK):
            yield pdf.iloc[first:first + BLOCK]


def check_vectors(df: DataFrame, cfg: FusionConfig) -> DataFrame:
    """``df`` with an error raised on the first row one of whose vectors has another size than the model's."""
    sizes = F.array(*[F.coalesce(F.size(c), F.lit(-1)) for c in MODALITIES])
    good = F.forall(sizes, lambda n: n == cfg.embedding_dim)
    said = F.concat(F.lit(f"vectors of {', '.join(MODALITIES)} must have {cfg.embedding_dim} components; sizes are "),
                    F.to_json(sizes))
    return df.withColumn(MODALITIES[0], F.when(good, F.col(MODALITIES[0])).otherwise(F.raise_error(said)))


# ------------------------------------------------------------------ M10 / M12 / S18
SCORE_SCHEMA = "sample_id string, label int, logit double, probability double, prediction int, attention array<double>"


def score(df: DataFrame, params: dict[str, np.ndarray], cfg: FusionConfig, threshold: float = 0.5,
          id_col: str = "sample_id", label_col: str = "label") -> DataFrame:
    """Logits, probabilities, thresholded predictions and attention per row."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"a threshold is a probability, not {threshold}")
    bc = df.sparkSession.sparkContext.broadcast(params)
    conf = asdict(cfg)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = FusionConfig(**conf)
        p = bc.value
        for pdf in _blocks(batches):
            xs = _inputs(pdf)
            logit, alpha, _ = _forward(p, c, xs, None)
            prob = 1.0 / (1.0 + np.exp(-logit))
            yield pd.DataFrame({"sample_id": pdf[id_col].astype(str), "label": pdf[label_col],
                                "logit": logit, "probability": prob,
                                "prediction": (prob >= threshold).astype(np.int32), "attention": list(alpha)})

    cols = [F.col(id_col).cast("string").alias(id_col), F.col(label_col).cast("int").alias(label_col),
            *[F.col(c) for c in MODALITIES]]
    return check_vectors(df.select(*cols), cfg).mapInPandas(run, SCORE_SCHEMA)


# ------------------------------------------------------------------ M14 / M15
class RowDropout:
    """Uniform numbers for a batch, each row's from the row's own generator."""

    def __init__(self, rows: list[np.random.Generator]):
        self.rows = rows

    def random(self, shape) -> np.ndarray:
        return np.stack([g.random(shape[1:]) for g in self.rows])


def _partition_gradients(df: DataFrame, bc, cfg: FusionConfig, seed: int, label_col: str):
    conf = asdict(cfg)
    keys = sorted(bc.value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib
        c = FusionConfig(**conf)
        p = bc.value
        total = {k: np.zeros_like(v) for k, v in p.items()}
        n, loss_sum, correct = 0, 0.0, 0
        for pdf in _blocks(batches):
            xs = _inputs(pdf)
            y = pdf[label_col].to_numpy().astype(np.float64)
            # dropout follows the row, whatever batch or partition it is in
            rng = RowDropout([np.random.default_rng([seed, zlib.crc32(i.encode())]) for i in pdf["sample_id"]]) if c.dropout else None
            logit, _, cache = _forward(p, c, xs, rng)
            dl = 1.0 / (1.0 + np.exp(-logit)) - y
            g = _backward(p, c, cache, dl)
            for k in total:
                total[k] += g[k]
            n += len(y)
            loss_sum += float(_bce(logit, y).sum())
            correct += int(((1.0 / (1.0 + np.exp(-logit)) >= 0.5) == (y == 1)).sum())
        flat = np.concatenate([total[k].ravel() for k in keys]) if n else np.zeros(0)
        yield pd.DataFrame({"n": [n], "loss_sum": [loss_sum], "correct": [correct], "grad": [flat.tobytes()]})

    return df.mapInPandas(run, "n long, loss_sum double, correct long, grad binary")


def _tree_sum(parts: DataFrame, size: int):
    """Sum per-partition gradient blobs with a tree reduce (depth 2)."""
    def to_arr(r):
        g = np.frombuffer(r["grad"], dtype=np.float64) if r["n"] else np.zeros(size)
        return (r["n"], r["loss_sum"], r["correct"], g)

    def add(a, b):
        return (a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3])
    return parts.rdd.map(to_arr).treeReduce(add, depth=2)


def evaluate(df: DataFrame, params, cfg: FusionConfig, label_col: str = "label") -> tuple[float, float]:
    """M13 on model logits: mean BCE loss and error; NaN for an empty table."""
    from .metrics import bce_loss
    s = score(df, params, cfg, label_col=label_col)
    r = bce_loss(s, "logit", "label").first()
    return float(r["loss"]), float(r["error"])


def train(train_df: DataFrame, cfg: FusionConfig, epochs: int = 10, learning_rate: float = 1e-3,
          steps_per_epoch: int = 1, seed: int = 0, validation_df: DataFrame | None = None,
          weight_decay: float = 0.01, label_col: str = "label") -> tuple[dict, DataFrame]:
    """AdamW on synchronous data-parallel gradients; returns weights and the epoch history.

    Each step uses a seeded ``1/steps_per_epoch`` sample of the training rows
    (``steps_per_epoch = 1`` is full-batch).  The history DataFrame has
    ``epoch, train_loss, train_error, validation_loss, validation_error``.
    """
    if epochs <= 0:
        raise ValueError(f"training needs at least one epoch, not {epochs}")
    spark = train_df.sparkSession
    data = train_df.select(F.col("sample_id").cast("string").alias("sample_id"),
                           F.col(label_col).cast("double").alias(label_col), *MODALITIES)
    if data.where(F.col(label_col).isNull()).limit(1).count():
        raise ValueError("training rows without a label; repair or drop them first")
    data = materialize(data)  # every step and epoch reads it
    if data.limit(1).count() == 0:
        raise EmptySplitError("training split is empty")
    params = init_params(cfg, seed)
    keys = sorted(params)
    size = sum(params[k].size for k in keys)
    m1 = {k: np.zeros_like(v) for k, v in params.items()}
    m2 = {k: np.zeros_like(v) for k, v in params.items()}
    b1, b2, eps = 0.9, 0.999, 1e-8
    t = 0
    history = []
    for epoch in range(1, epochs + 1):
        n_ep, loss_ep, corr_ep = 0, 0.0, 0
        for step in range(steps_per_epoch):
            batch = data if steps_per_epoch == 1 else data.where(
                F.pmod(F.xxhash64(F.col("sample_id"), F.lit(seed), F.lit(epoch)), F.lit(steps_per_epoch)) == step)
            bc = spark.sparkContext.broadcast(params)  # ~50k floats, re-sent every step
            n, loss_sum, correct, gsum = _tree_sum(_partition_gradients(batch, bc, cfg, seed * 1000003 + t,
                                                                        label_col), size)
            bc.unpersist()
            if n == 0:
                continue
            t += 1
            n_ep += n
            loss_ep += loss_sum
            corr_ep += correct
            off = 0
            for k in keys:
                sz = params[k].size
                grad = gsum[off:off + sz].reshape(params[k].shape) / n
                off += sz
                params[k] = params[k] * (1.0 - learning_rate * weight_decay)
                m1[k] = b1 * m1[k] + (1 - b1) * grad
                m2[k] = b2 * m2[k] + (1 - b2) * grad * grad
                mh = m1[k] / (1 - b1 ** t)
                vh = m2[k] / (1 - b2 ** t)
                params[k] = params[k] - learning_rate * mh / (np.sqrt(vh) + eps)
        row = {"epoch": epoch, "train_loss": loss_ep / n_ep if n_ep else float("nan"),
               "train_error": 1.0 - corr_ep / n_ep if n_ep else float("nan"),
               "validation_loss": None, "validation_error": None}
        if validation_df is not None:
            row["validation_loss"], row["validation_error"] = evaluate(validation_df, params, cfg, label_col)
        history.append(row)
    schema = T.StructType([T.StructField("epoch", T.IntegerType()), T.StructField("train_loss", T.DoubleType()),
                           T.StructField("train_error", T.DoubleType()),
                           T.StructField("validation_loss", T.DoubleType()),
                           T.StructField("validation_error", T.DoubleType())])
    return params, spark.createDataFrame(history, schema)


# ------------------------------------------------------------------ S17
def save(spark: SparkSession, params: dict, cfg: FusionConfig, path: str, metrics: dict | None = None) -> None:
    """Weights as a Parquet table (param, shape, values) plus a one-row JSON config."""
    rows = [(k, list(map(int, v.shape)), v.ravel().astype(float).tolist()) for k, v in sorted(params.items())]
    spark.createDataFrame(rows, "param string, shape array<int>, values array<double>") \
        .write.mode("overwrite").parquet(f"{path}/weights")
    spark.createDataFrame([(json.dumps(asdict(cfg)), json.dumps(metrics or {}))], "model_config string, metrics string") \
        .write.mode("overwrite").json(f"{path}/config")


def load(spark: SparkSession, path: str) -> tuple[dict, FusionConfig]:
    """Read weights and config back; a missing part is an error."""
    conf = spark.read.json(f"{path}/config").first()
    if conf is None or conf["model_config"] is None:
        raise ValueError("checkpoint has no model_config")
    w = spark.read.parquet(f"{path}/weights").collect()
    if not w:
        raise ValueError("checkpoint has no model weights")
    params = {r["param"]: np.asarray(r["values"], dtype=np.float64).reshape(r["shape"]) for r in w}
    return params, FusionConfig(**json.loads(conf["model_config"]))
