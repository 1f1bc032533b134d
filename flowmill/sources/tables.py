"""Vocabularies, label maps, encoded instances and error tables on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.sources.lines import numbered_lines


def write_vocab(vocab: DataFrame, path: str) -> None:
    """One token per line in id order; the line number, counted on over the files, is the id.

    Each task writes a range of ids, and the files' names are in the order of the ranges.
    """
    parts = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vocab.repartitionByRange(parts, "id").sortWithinPartitions("id").select("token").write.text(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token, id); the id is the line number, and a repeated token keeps its last."""
    lines = numbered_lines(spark, path)
    rows = lines.select(F.split(F.btrim("value"), r"\s+")[0].alias("token"), F.col("line").alias("id"))
    return rows.groupBy("token").agg(F.max("id").alias("id"))


def write_instances(instances: DataFrame, path: str) -> None:
    """Parquet part files take the place of merging worker outputs."""
    instances.write.parquet(path)


def read_instances(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def write_label_map(labels: DataFrame, path: str) -> None:
    labels.select("label_name", F.col("label").cast("int")).write.parquet(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("label_name string, label int").parquet(path)


ERROR_COLUMNS = (
    "sample_index", "true_label_id", "true_label_name", "pred_label_id", "pred_label_name", "confidence",
)


def write_errors_csv(errors: DataFrame, path: str) -> bool:
    """Misclassified samples as CSV with a header, least confident first; nothing when there are none."""
    if errors.isEmpty():
        return False
    out = errors.orderBy("confidence", "sample_index").withColumn("confidence", F.format_string("%.6f", F.col("confidence")))
    out.select(*ERROR_COLUMNS).write.option("header", True).csv(path)
    return True
