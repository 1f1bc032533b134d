"""Predictions, confusion counts and the metrics derived from them.

Only the confusion count reads the predictions; every metric works on its
(classes x classes) result, which is one row per pair that occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions.arrays import log_sum_exp

# Fixed values.
SMALL, MASKED_SMALL, SIGMA = 1e-9, 1e-6, 10


def predict_argmax(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Add y_pred (first maximum) and confidence (its softmax probability)."""
    top = F.array_max(logits)
    return df.withColumns({
        "y_pred": (F.array_position(logits, top) - 1).cast("int"),
        "confidence": F.exp(top - log_sum_exp(F.col(logits))),
    })


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def _class_sums(confusion: DataFrame) -> DataFrame:
    """Per class: tp, predicted and actual counts, over classes of either side."""
    # Each cell counts for two classes; exploded, so that the predictions are read once.
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    nothing = F.lit(0).cast("bigint")
    sides = confusion.select(F.inline(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("actual"), nothing.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("y_pred").alias("label"), nothing.alias("actual"), F.col("n").alias("predicted"), nothing.alias("tp")),
    )))
    return sides.groupBy("label").agg(
        *[F.sum(c).alias(c) for c in ("tp", "predicted", "actual")]
    )


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def overall_metrics(confusion: DataFrame) -> DataFrame:
    """One row: accuracy; precision, recall, F1 as macro, micro and weighted averages."""
    c = _class_sums(confusion).withColumns({
        "precision": _ratio(F.col("tp"), F.col("predicted")),
        "recall": _ratio(F.col("tp"), F.col("actual")),
        "f1": _ratio(2 * F.col("tp"), F.col("predicted") + F.col("actual")),
    })
    scores = ("precision", "recall", "f1")
    one = c.agg(
        F.sum("tp").alias("correct"), F.sum("actual").alias("total"),
        F.sum("predicted").alias("_predicted"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[F.sum(F.col(s) * F.col("actual")).alias(f"_w_{s}") for s in scores],
    )
    total = F.col("total")
    return one.select(
        "correct", "total", _ratio(F.col("correct"), total).alias("accuracy"),
        *[F.col(f"macro_{s}") for s in scores],
        _ratio(F.col("correct"), F.col("_predicted")).alias("micro_precision"),
        _ratio(F.col("correct"), total).alias("micro_recall"),
        _ratio(2 * F.col("correct"), F.col("_predicted") + total).alias("micro_f1"),
        *[_ratio(F.col(f"_w_{s}"), total).alias(f"weighted_{s}") for s in scores],
    )


def per_class_metrics(confusion: DataFrame, labels: DataFrame | None = None, keep_unsupported: bool = False) -> DataFrame:
    """Precision, recall, F1 and support per class, worst F1 first."""
    c = _class_sums(confusion)
    if not keep_unsupported:
        c = c.filter(F.col("actual") > 0)
    p = F.col("tp") / (F.col("predicted") + SMALL)
    r = F.col("tp") / (F.col("actual") + SMALL)
    c = c.select("label", p.alias("precision"), r.alias("recall"), F.col("actual").alias("support"))
    c = c.withColumn(
        "f1",
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + SMALL),
    )
    if labels is not None:
        c = id_to_label(c, labels, "label", "label_name")
    return c.orderBy("f1", "label")


def id_to_label(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """Add the label's name; an unknown id becomes its number as text.

    The label table is small, but Spark decides on a broadcast from its size.
    """
    names = labels.select(F.col("label").alias("_id"), F.col("label_name").alias("_name"))
    return (
        df.join(names, F.col(column) == F.col("_id"), "left")
        .withColumn(name, F.coalesce("_name", F.col(column).cast("string")))
        .drop("_id", "_name")
    )


def misclassified(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Errors with both names, in the columns of the error table."""
    wrong = predictions.filter(F.col("y_true") != F.col("y_pred"))
    named = id_to_label(id_to_label(wrong, labels, "y_true", "true_label_name"), labels, "y_pred", "pred_label_name")
    return named.select(
        F.col("sample_id").alias("sample_index"), F.col("y_true").alias("true_label_id"), "true_label_name",
        F.col("y_pred").alias("pred_label_id"), "pred_label_name", "confidence",
    )


def misclassified_topk(errors: DataFrame, k: int) -> DataFrame:
    """The k least confident errors; all of them, sorted, when k is 0 or less."""
    ordered = errors.orderBy("confidence", "sample_index")
    return ordered.limit(k) if k > 0 else ordered


def masked_accuracy(targets: DataFrame, sigma: int = SIGMA) -> DataFrame:
    """Over masked positions: exact matches and matches within ``sigma``."""
    gap = F.abs(F.col("prediction") - F.col("target"))
    n = F.count(F.lit(1))
    exact, near = F.count(F.when(gap == 0, 1)), F.count(F.when(gap <= sigma, 1))
    return targets.agg(
        n.alias("n"), exact.alias("exact"), near.alias("within_sigma"),
        F.round(exact / (n + F.lit(MASKED_SMALL)), 6).alias("accuracy"),
        F.round(near / (n + F.lit(MASKED_SMALL)), 6).alias("range_accuracy"),
    )
