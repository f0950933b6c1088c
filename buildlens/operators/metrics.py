"""Evaluation operators (M1-M4, M6, M11, M13, P16): single-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M2: tn, fp, fn, tp in one aggregate (partial counts combine map-side)."""
    y, p = F.col(label), F.col(prediction)
    return df.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
                  F.count(F.lit(1)).alias("n"))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M1: accuracy, precision, recall, F1; zero denominators -> 0.0; no rows -> NaN."""
    c = confusion_counts(df, label, prediction)
    tp, tn, fp, fn, n = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn", "n"))
    nan = F.lit(float("nan"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    empty = F.col("n") == 0
    return c.select(
        F.when(empty, nan).otherwise((tp + tn) / n).alias("accuracy"),
        F.when(empty, nan).otherwise(prec).alias("precision"),
        F.when(empty, nan).otherwise(rec).alias("recall"),
        F.when(empty, nan).otherwise(f1).alias("f1"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M2: 2x2 matrix [[tn, fp], [fn, tp]]."""
    c = confusion_counts(df, label, prediction)
    return c.select(F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("matrix"))


def confusion_table(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M3: labelled table: one row per actual label (0 and 1), predicted 0 / 1 counts."""
    c = confusion_counts(df, label, prediction)
    return c.select(F.explode(F.array(
        F.struct(F.lit(0).alias("actual"), F.col("tn").alias("predicted_0"), F.col("fp").alias("predicted_1")),
        F.struct(F.lit(1).alias("actual"), F.col("fn").alias("predicted_0"), F.col("tp").alias("predicted_1")))
    ).alias("r")).select("r.*")


def result_table(df: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M4: keys, label, prediction and 0/1 correctness per sample."""
    return df.select(*keys, label, prediction, (F.col(label) == F.col(prediction)).cast("int").alias("accuracy"))


def class_weights(df: DataFrame, label: str = "label", mode: str | dict = "balanced") -> DataFrame:
    """M6: weight per class; "balanced" = n / (k * n_c) ("balanced_subsample" maps to it)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    if isinstance(mode, dict):
        return counts.select(label, F.coalesce(
            F.element_at(F.create_map(*[x for k, v in mode.items() for x in (F.lit(k), F.lit(float(v)))]),
                         F.col(label)), F.lit(1.0)).alias("weight"))
    if mode is None:
        return counts.select(label, F.lit(1.0).alias("weight"))
    if mode not in ("balanced", "balanced_subsample"):
        raise ValueError(f"unknown class weight mode {mode!r}")
    # ``counts`` has one row per class, so a whole-table window over it is tiny.
    everything = Window.partitionBy()
    return counts.select(label, (F.sum("n_c").over(everything)
                                 / (F.count(F.lit(1)).over(everything) * F.col("n_c"))).alias("weight"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bce_with_logits(logit: Column, label: Column) -> Column:
    """Numerically stable binary cross-entropy on a logit."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def bce_loss(df: DataFrame, logit: str = "logit", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Mean BCE-with-logits and error = 1 - accuracy at ``threshold``; no rows -> NaN."""
    x, y = F.col(logit), F.col(label).cast("double")
    pred = (sigmoid(x) >= threshold).cast("double")
    agg = df.agg(F.avg(bce_with_logits(x, y)).alias("loss"), F.avg((pred == y).cast("double")).alias("acc"),
                 F.count(F.lit(1)).alias("n"))
    nan = F.lit(float("nan"))
    return agg.select(F.when(F.col("n") == 0, nan).otherwise(F.col("loss")).alias("loss"),
                      F.when(F.col("n") == 0, nan).otherwise(1.0 - F.col("acc")).alias("error"))


def softmax3(a: Column, b: Column, c: Column) -> Column:
    """Softmax over three scores as array<double> (max-shifted)."""
    m = F.greatest(a, b, c)
    ea, eb, ec = F.exp(a - m), F.exp(b - m), F.exp(c - m)
    s = ea + eb + ec
    return F.array(ea / s, eb / s, ec / s)


def attention_weights(scores: Column) -> Column:
    """M11 (first half): softmax of the three modality scores."""
    return softmax3(scores[0], scores[1], scores[2])


def attention_fuse(weights: Column, v1: Column, v2: Column, v3: Column) -> Column:
    """M11 (second half): weighted sum of the three vectors.

    ``weights`` should be a materialised column (see ``attention_weights``) so
    the softmax is not re-evaluated per element inside the lambdas.
    """
    return F.zip_with(F.zip_with(v1, v2, lambda x, y: weights[0] * x + weights[1] * y), v3,
                      lambda xy, z: xy + weights[2] * z)
