"""Applying a fitted model in batches, and a baseline classifier of flows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.functions.arrays import let
from flowmill.operators import evaluate as ev
from flowmill.operators.encode import PAD, RESERVED


def score_batches(
    df: DataFrame, load: Callable, column: str, width: int, batch_size: int = 1024
) -> DataFrame:
    """Add ``logits``. ``load()`` runs once per worker and returns the predict function."""
    predict = predict_batch_udf(
        load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    return df.withColumn("logits", predict(column))


def histogram(ids: Column, bins: int, per_bin: int) -> Column:
    """Share of a row's tokens in each of ``bins`` ranges of ``per_bin`` ids."""
    def shares(s):
        n = F.greatest(F.size(s), F.lit(1))
        return F.transform(
            F.sequence(F.lit(0), F.lit(bins - 1)),
            lambda b: F.size(F.filter(s, lambda x: F.floor((x - RESERVED) / per_bin) == b)) / n,
        )

    return let(F.filter(ids, lambda x: (x != PAD) & (x >= RESERVED)), shares)


def features(df: DataFrame) -> DataFrame:
    """Byte, size and IAT histograms of an encoded row as one vector."""
    parts = F.concat(
        histogram(F.col("src"), 16, 16), histogram(F.col("src_size"), 30, 101),
        histogram(F.col("src_iat"), 20, 50),
    )
    return df.withColumn("features", array_to_vector(parts))


def baseline_flow_classifier(samples: DataFrame, strengths=(0.001, 0.01, 0.1)):
    """Fit on the train split, choose by macro F1 on val; returns (model, test predictions).

    ``samples`` has features, label and split and is read once per candidate, so
    it should be a stored table.
    """
    best, best_score = None, -1.0
    for strength in strengths:
        fit = LogisticRegression(regParam=strength, maxIter=50).fit(samples.filter("split = 'train'"))
        row = ev.overall_metrics(
            ev.confusion_matrix(predict(fit, samples.filter("split = 'val'")))
        ).first()
        if row is not None and (row.macro_f1 or 0.0) > best_score:
            best, best_score = fit, row.macro_f1 or 0.0
    return best, predict(best, samples.filter("split = 'test'"))


def predict(model, samples: DataFrame) -> DataFrame:
    """sample_id, y_true, y_pred, confidence."""
    return model.transform(samples).select(
        F.col("flow_key").alias("sample_id"), F.col("label").cast("int").alias("y_true"),
        F.col("prediction").cast("int").alias("y_pred"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )
