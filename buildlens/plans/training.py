"""Model runs over stored shards: the training and prediction lifecycles.

    shards (+ sidecar labels) -> shards of the first N (L1) -> label repair (J5) -> first N ->
    repo split (G10) -> features (P11) -> fit (M5/M6) -> metrics, confusion,
    result table (M1-M4) -> checkpoint (S16, S17)

    stored shards -> first N -> fusion scoring (M10/M12) -> predictions (S18)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forest as RF
from ..operators import fusion as FU
from ..operators import metrics as M
from ..operators.diffs import materialize
from ..operators.splits import assign_splits, first_n_samples, split_repos
from ..sources import manifest as MF
from ..sources import shards as SH


def load_samples(spark: SparkSession, out_dir: str, num_samples: int | None = None) -> DataFrame:
    """Stored samples with labels repaired from the sidecar (shard-pruned first N)."""
    entries = MF.snapshot(spark, out_dir).select("shard_index", "num_samples")
    if not entries.limit(1).count():
        raise FileNotFoundError(f"no shards are listed in {out_dir}")
    first = SH.first_n_from_shards(MF.live_vectors(spark, out_dir).drop("run_id"), entries, num_samples, whole_shards=True)
    side = MF.live_texts(spark, out_dir, "record_index int, label int").select("shard_index", "record_index", F.col("label").alias("sidecar_label"))
    joined = first.join(side, ["shard_index", "record_index"], "left")
    repaired = SH.repair_labels(joined)
    bad = repaired.where("label_error").limit(1).count()
    if bad:
        raise ValueError("a shard with missing labels has no sidecar label to repair them")
    repaired = repaired.drop("label", "sidecar_label", "label_error").withColumnRenamed("label_repaired", "label")
    return first_n_samples(repaired, num_samples)


def train_forest(spark: SparkSession, out_dir: str, model_dir: str, num_samples: int | None = None,
                 num_trees: int = 300, max_depth: int | None = None, seed: int = 0) -> DataFrame:
    """Fit on the train repos, score validation and test, write the test result table and
    the checkpoint; returns per-split metrics."""
    samples = load_samples(spark, out_dir, num_samples)
    model, per_split, test = RF.train_and_score(samples, num_trees=num_trees, max_depth=max_depth, seed=seed)
    metrics = M.binary_metrics(test).first().asDict()
    SH.write_result_table(M.result_table(test, ["repo", "commit_sha"]), f"{model_dir}/test_results")
    SH.write_result_table(M.confusion_table(test), f"{model_dir}/confusion")
    RF.save(model, model_dir, {"num_trees": num_trees, "max_depth": max_depth, "seed": seed,
                               "num_samples": num_samples}, metrics)
    return per_split


def predict_forest(spark: SparkSession, out_dir: str, model_dir: str, pred_dir: str, num_samples: int | None = None,
                   validation_fraction: float = 0.2, test_fraction: float = 0.2) -> DataFrame:
    """M7: score the test repos with a saved forest; samples and seed default to those that it was trained with.

    Writes the result table and the confusion table; returns the metrics.  No test rows is an error (M8).
    """
    model, config = RF.load(model_dir)
    samples = load_samples(spark, out_dir, config.get("num_samples") if num_samples is None else num_samples)
    split = assign_splits(samples, split_repos(samples, validation_fraction, test_fraction, config.get("seed", 0)))
    test = split.where("split = 'test'")
    if not test.limit(1).count():
        raise RF.EmptySplitError("no test rows to score")
    scored = materialize(RF.predict(model, test))
    SH.write_result_table(M.result_table(scored, ["repo", "commit_sha"]), f"{pred_dir}/test_results")
    SH.write_result_table(M.confusion_table(scored), f"{pred_dir}/confusion")
    return M.binary_metrics(scored)


def sweep_forest(spark: SparkSession, out_dir: str, sweep_dir: str, sizes: list[int], **options) -> DataFrame:
    """M9 over stored shards: the sweep's table, written as CSV."""
    samples = load_samples(spark, out_dir, max(sizes, default=None))
    table = materialize(RF.sample_sweep(samples, sizes, **options))
    SH.write_result_table(table, f"{sweep_dir}/sweep")
    return table


def train_fusion(spark: SparkSession, out_dir: str, model_dir: str, num_samples: int | None = None, epochs: int = 30, seed: int = 0,
                 validation_fraction: float = 0.2, test_fraction: float = 0.2, **options) -> DataFrame:
    """M14/M15 over stored shards: fit on the train repos, history per epoch, then the test split's loss, error and
    confusion; weights, configuration and metrics are stored.  Returns the history.
    """
    samples = load_samples(spark, out_dir, num_samples)
    first = samples.select(F.size("message_embedding").alias("d")).limit(1).collect()
    if not first:
        raise RF.EmptySplitError("no samples to train on")
    cfg = FU.FusionConfig(embedding_dim=first[0]["d"])
    split = materialize(assign_splits(samples, split_repos(samples, validation_fraction, test_fraction, seed)))
    sizes = RF.split_sizes(split)
    if not sizes["train"] or not sizes["test"]:
        raise RF.EmptySplitError(f"train and test need rows: {sizes}")
    validation = split.where("split = 'validation'") if sizes["validation"] else None
    params, history = FU.train(split.where("split = 'train'"), cfg, epochs=epochs, seed=seed, validation_df=validation, **options)
    test = split.where("split = 'test'")
    loss, error = FU.evaluate(test, params, cfg)
    scored = materialize(FU.score(test, params, cfg))
    SH.write_result_table(M.confusion_table(scored), f"{model_dir}/confusion")
    SH.write_result_table(history, f"{model_dir}/history")
    FU.save(spark, params, cfg, model_dir, {"test_loss": loss, "test_error": error, "epochs": epochs, "seed": seed, **sizes})
    return history


def predict_fusion(spark: SparkSession, out_dir: str, model_dir: str, pred_dir: str,
                   num_samples: int | None = None, threshold: float = 0.5) -> DataFrame:
    """Score the first N stored samples with a saved fusion model (no split); writes the
    predictions and returns one row with n and error = 1 - correct / n."""
    params, cfg = FU.load(spark, model_dir)
    samples = load_samples(spark, out_dir, num_samples)
    scored = FU.score(samples, params, cfg, threshold)
    SH.write_predictions(scored, pred_dir)
    return spark.read.json(pred_dir).agg(
        F.count(F.lit(1)).alias("n"),
        (1.0 - F.avg((F.col("prediction") == F.col("label")).cast("double"))).alias("error"))
