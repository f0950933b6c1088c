"""Random-forest baseline (M5-M9, S17) on ``trees``: level-wise forests of any depth.

Features are the concatenated modality vectors (P11).  Class weights (M6) are two numbers of the
training rows.  Features are binned and rows drawn by hashes, so trees differ from other libraries; metrics are
what is compared.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import metrics as M
from . import trees as TR
from .diffs import materialize
from .splits import SPLITS, assign_splits, first_n_samples, split_repos

FEATURES = ["message_embedding", "diff_embedding", "context_embedding"]


class EmptySplitError(ValueError):
    pass


def split_sizes(df: DataFrame) -> dict:
    """M8: rows per split (three numbers reach the driver)."""
    counts = {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {s: int(counts.get(s, 0)) for s in SPLITS}


def fit(train: DataFrame, num_trees: int = 300, max_depth: int | None = None, seed: int = 0,
        class_weight="balanced", label: str = "label", **settings) -> TR.TreeModel:
    """M5: fit the forest (square root of the features per node, Poisson bagging, no depth limit by default)."""
    if max_depth is not None and max_depth < 1:
        raise ValueError("max_depth must be at least 1, or None for no limit")
    by_class = {r[label]: float(r["weight"]) for r in M.class_weights(train, label, class_weight).collect()}  # a row per class
    cfg = TR.TreeConfig(num_trees=num_trees, max_depth=max_depth, seed=seed, **settings)
    return TR.fit(train.withColumn("_row", F.xxhash64("sample_id")), FEATURES, label, "_row", cfg, (by_class.get(0, 1.0), by_class.get(1, 1.0)))


def predict(model: TR.TreeModel, df: DataFrame) -> DataFrame:
    """M7: predictions (int) for each row: class 1 if its mean share over the trees is above a half."""
    scored = TR.predict(model, df, FEATURES, "_share")
    return scored.withColumn("prediction", (F.col("_share") > 0.5).cast("int")).drop("_share")


def train_and_score(samples: DataFrame, num_samples: int | None = None, validation_fraction: float = 0.2,
                    test_fraction: float = 0.2, seed: int = 0, shuffle: bool = True, num_trees: int = 300,
                    max_depth: int | None = None, label: str = "label") -> tuple[TR.TreeModel, DataFrame, DataFrame]:
    """Load first N, split by repo, fit on train, score validation and test.

    Returns (model, metrics per split, test predictions).
    """
    s = first_n_samples(samples, num_samples)
    if s.where(F.col(label).isNull()).limit(1).count():
        raise ValueError("samples without a label; repair or drop them first")
    if s.limit(1).count() == 0:
        raise EmptySplitError("no samples to train on")
    with_split = assign_splits(s, split_repos(s, validation_fraction, test_fraction, seed, shuffle)).persist()
    sizes = split_sizes(with_split)
    if sizes["train"] == 0:
        raise EmptySplitError("training split is empty")
    if sizes["test"] == 0:
        raise EmptySplitError("test split is empty")
    model = fit(with_split.where(F.col("split") == "train"), num_trees, max_depth, seed, label=label)
    scored = materialize(predict(model, with_split.where(F.col("split") != "train")))
    with_split.unpersist()
    metrics = scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(label) == F.col("prediction")).cast("double")).alias("accuracy"),
        F.count_if((F.col(label) == 1) & (F.col("prediction") == 1)).alias("tp"),
        F.count_if((F.col(label) == 0) & (F.col("prediction") == 1)).alias("fp"),
        F.count_if((F.col(label) == 1) & (F.col("prediction") == 0)).alias("fn"),
        F.count_if((F.col(label) == 0) & (F.col("prediction") == 0)).alias("tn"))
    return model, metrics, scored.where(F.col("split") == "test")


def budget_counts(samples: DataFrame, sizes: list[int], index_col: str = "global_index") -> DataFrame:
    """(budget, repo, n_samples, first_seen) for all budgets, from one aggregate over the samples.

    A sample adds to the step between two budgets that it lies in; running sums over the steps, a row per
    repo and budget, give every budget's counts.
    """
    steps = sorted(set(sizes))
    step = F.lit(None).cast("long")
    for n in reversed(steps):
        step = F.when(F.col(index_col) < n, F.lit(n).cast("long")).otherwise(step)
    per = samples.select("repo", index_col, step.alias("budget")).where("budget IS NOT NULL") \
        .groupBy("repo", "budget").agg(F.count(F.lit(1)).alias("n"), F.min(index_col).alias("first"))
    grid = per.select("repo").distinct().withColumn("budget", F.explode(F.array(*[F.lit(n).cast("long") for n in steps])))
    upto = Window.partitionBy("repo").orderBy("budget").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(per, ["repo", "budget"], "left") \
        .select("budget", "repo", F.sum("n").over(upto).alias("n_samples"), F.min("first").over(upto).alias("first_seen")).where("n_samples > 0")


def sweep_splits(samples: DataFrame, sizes: list[int], validation_fraction: float = 0.2, test_fraction: float = 0.2,
                 seed: int = 0, shuffle: bool = True) -> DataFrame:
    """(budget, repo, n_samples, split) of all budgets; the samples are read once."""
    if not sizes or any(n <= 0 for n in sizes):
        raise ValueError("a sweep needs sample sizes, all of them positive")
    counts = materialize(budget_counts(samples, sizes))
    out = None
    for n in sorted(set(sizes)):
        own = counts.where(F.col("budget") == n)
        part = own.join(split_repos(own, validation_fraction, test_fraction, seed, shuffle, summarised=True).select("repo", "split"), "repo")
        out = part if out is None else out.unionByName(part)
    return out.select("budget", "repo", "n_samples", "split")


def sample_sweep(samples: DataFrame, sizes: list[int], label: str = "label", num_trees: int = 300, max_depth: int | None = None,
                 **split_options) -> DataFrame:
    """M9: one row per budget: loaded samples, sizes and repos of the splits, and test metrics; NaN metrics when train or test is empty."""
    if samples.where(F.col(label).isNull()).limit(1).count():
        raise ValueError("samples without a label; repair or drop them first")
    spark, samples = samples.sparkSession, materialize(samples)
    splits = materialize(sweep_splits(samples, sizes, **split_options))
    shape = {(r["budget"], r["split"]): (r["n"], r["k"]) for r in splits.groupBy("budget", "split").agg(
        F.sum("n_samples").alias("n"), F.count(F.lit(1)).alias("k")).collect()}  # three rows per budget
    rows = []
    for n in sizes:
        size, repos = ({s: int(shape.get((n, s), (0, 0))[i]) for s in SPLITS} for i in (0, 1))
        row = {"num_samples": n, "loaded_samples": sum(size.values())} | {f"{s}_size": size[s] for s in SPLITS} | {f"{s}_repos": repos[s] for s in SPLITS}
        row |= dict.fromkeys(("accuracy", "precision", "recall", "f1"), float("nan"))
        if size["train"] and size["test"]:
            own = splits.where(F.col("budget") == n).select("repo", "split")
            with_split = samples.where(F.col("global_index") < n).join(own, "repo")
            model = fit(with_split.where("split = 'train'"), num_trees, max_depth, split_options.get("seed", 0), label=label)
            m = M.binary_metrics(predict(model, with_split.where("split = 'test'")), label).first()
            row |= {k: float(m[k]) for k in ("accuracy", "precision", "recall", "f1")}
        rows.append(row)
    return spark.createDataFrame(rows, "num_samples long, loaded_samples long, train_size long, validation_size long, test_size long, "
                                       "train_repos long, validation_repos long, test_repos long, accuracy double, precision double, recall double, f1 double")


def save(model: TR.TreeModel, path: str, config: dict, metrics: dict) -> None:
    """The forest's tables + a one-row JSON side file with config and metrics."""
    TR.save(model, f"{path}/model")
    model.nodes.sparkSession.createDataFrame([(json.dumps(config), json.dumps(metrics))], "model_config string, metrics string") \
        .write.mode("overwrite").json(f"{path}/config")


def load(path: str) -> tuple[TR.TreeModel, dict]:
    """Model and stored training config (missing parts are errors)."""
    spark = SparkSession.getActiveSession()
    conf = spark.read.json(f"{path}/config").first()
    if conf is None or conf["model_config"] is None:
        raise ValueError("checkpoint has no model_config")
    return TR.load(spark, f"{path}/model"), json.loads(conf["model_config"])
