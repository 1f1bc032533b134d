"""Putting the byte and the size modality of a flow into one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.sources import corpus


def pair_modalities(raw: DataFrame, size: DataFrame, key: str = "flow_key") -> DataFrame:
    """Inner join on the flow; rows whose IAT sequence is empty are skipped."""
    iat = next(c for c in ("src_iat", "iat_tokens") if c in size.columns)
    shared = [c for c in size.columns if c in raw.columns and c != key]
    return raw.join(size.drop(*shared), key).filter(F.size(iat) > 0)


def pair_corpora(spark: SparkSession, raw_path: str, size_path: str, strict: bool = True) -> DataFrame:
    """Pair the n-th record of a raw corpus with the n-th of a size corpus, to the shorter length.

    Rows: record, protocol (of the raw side), size_protocol, packets, size_tokens, iat_tokens. Pairs whose
    sides disagree on the protocol stay, see :func:`pairing_audit`; those without IAT tokens are left out. Flows
    without packets stay. With ``strict`` a raw protocol that is no number raises.
    """
    raw, size = corpus.raw_flows(spark, raw_path, strict), corpus.size_flows(spark, size_path)
    both = raw.join(size.withColumnRenamed("protocol", "size_protocol"), "record")
    return both.filter(F.size("iat_tokens") > 0)


def pairing_audit(spark: SparkSession, raw_path: str, size_path: str) -> DataFrame:
    """One row of counts on two corpora: raw_flows, size_flows, pairs (by ordinal), protocol_mismatches and
    empty_iat (pairs left out). Flows are the separator lines."""
    n_raw = corpus.corpus_counts(spark, raw_path).select(F.col("flows").alias("raw_flows"))
    n_size = corpus.corpus_counts(spark, size_path).select(F.col("flows").alias("size_flows"))
    raw = corpus.raw_flows(spark, raw_path).select("record", "protocol")
    size = corpus.size_flows(spark, size_path).select("record", F.col("protocol").alias("size_protocol"), "iat_tokens")
    counts = raw.join(size, "record").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count(F.when(F.col("protocol") != F.col("size_protocol"), 1)).alias("protocol_mismatches"),
        F.count(F.when(F.size("iat_tokens") == 0, 1)).alias("empty_iat"))
    return n_raw.crossJoin(n_size).crossJoin(counts)  # one row each


def protocol_mismatches(raw: DataFrame, size: DataFrame, key: str = "flow_key") -> DataFrame:
    """Audit: pairs whose two sides disagree on the protocol (a warning, not a filter)."""
    both = raw.select(key, F.col("protocol").alias("raw_protocol")).join(
        size.select(key, F.col("protocol").alias("size_protocol")), key
    )
    return both.filter(F.col("raw_protocol") != F.col("size_protocol"))


def unpaired(raw: DataFrame, size: DataFrame, key: str = "flow_key") -> DataFrame:
    """Audit: flows present on one side only."""
    both = raw.select(key, F.lit(True).alias("in_raw")).join(
        size.select(key, F.lit(True).alias("in_size")), key, "full_outer"
    )
    return both.filter(F.col("in_raw").isNull() | F.col("in_size").isNull()).select(
        key, F.coalesce("in_raw", F.lit(False)).alias("in_raw"),
        F.coalesce("in_size", F.lit(False)).alias("in_size"),
    )
