"""Labelled samples: label ids, balancing, splits and their audits.

A class may hold any share of the samples; every per-class choice goes through
:func:`flowmill.functions.ranking.with_rank`, which never sorts a whole class.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions.ranking import hash_bucket, with_rank
from flowmill.functions.rng import hash_key

# Fixed values.
MIN_PER_CLASS, MAX_PER_CLASS, TRAIN_SHARE, VAL_SHARE = 10, 500, 0.8, 0.1


def label_counts(samples: DataFrame, minimum: int = MIN_PER_CLASS) -> DataFrame:
    """Samples per label, labels with fewer than ``minimum`` dropped."""
    return (
        samples.groupBy("label_name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= minimum)
    )


def label_ids(counts: DataFrame) -> DataFrame:
    """Label map: ids are ranks of the names. One row per class, so one task is enough."""
    order = Window.orderBy("label_name")
    return counts.select("label_name", (F.row_number().over(order) - 1).cast("int").alias("label"))


def attach_label_id(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join on the name; Spark broadcasts the map when it is small enough."""
    return samples.join(labels.select("label_name", "label"), "label_name")


def _ranked(samples: DataFrame, seed, ident: str, purpose: str, keep: Column | None) -> DataFrame:
    keyed = samples.withColumn("_key", hash_key(seed, purpose, F.col(ident)))
    return with_rank(
        keyed, ["label_name"], [F.col("_key")], hash_bucket(F.col("_key")),
        rank="rank", total="class_total", keep=keep, once=True,
    ).drop("_key")


def cap_per_class(samples: DataFrame, cap: int | None = MAX_PER_CLASS, seed=42, ident: str = "flow_key") -> DataFrame:
    """Uniform sample of at most ``cap`` per class, without replacement; None takes all."""
    return _ranked(samples, seed, ident, "sample", None if cap is None else F.col("rank") < cap)


def _taken(cap: int | None) -> Column:
    return F.col("class_total") if cap is None else F.least("class_total", F.lit(cap))


def stratified_split(
    samples: DataFrame, train: float = TRAIN_SHARE, val: float = VAL_SHARE,
    cap: int | None = MAX_PER_CLASS, seed=42, ident: str = "flow_key",
) -> DataFrame:
    """Add ``split``: per class int(n*train) train, int(n*val) val, the rest test."""
    kept = cap_per_class(samples, cap, seed, ident)
    n = _taken(cap)
    first = F.floor(n * F.lit(float(train)))
    second = first + F.floor(n * F.lit(float(val)))
    split = F.when(F.col("rank") < first, "train").when(F.col("rank") < second, "val").otherwise("test")
    return kept.withColumn("split", split).drop("rank", "class_total")


def split_with_test(
    samples: DataFrame, test: DataFrame, train: float = TRAIN_SHARE, val: float = VAL_SHARE,
    minimum: int = MIN_PER_CLASS, cap: int | None = MAX_PER_CLASS, seed=42, ident: str = "flow_key",
) -> DataFrame:
    """Train and val from one set, test from another: no cap and no minimum there.

    Test samples whose label was not kept for training are left out; see
    :func:`unseen_labels` for the report.
    """
    labels = label_ids(label_counts(samples, minimum))
    known = attach_label_id(samples, labels)
    parts = cap_per_class(known, cap, seed, ident)
    n = _taken(cap)
    cut = F.floor(n * F.lit(float(train) / (float(train) + float(val))))
    fit = parts.withColumn("split", F.when(F.col("rank") < cut, "train").otherwise("val"))
    held = attach_label_id(test, labels).withColumn("split", F.lit("test"))
    return fit.drop("rank", "class_total").unionByName(held)


def unseen_labels(test: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of the test set that the map does not have, with their sample counts."""
    return (
        test.groupBy("label_name").agg(F.count(F.lit(1)).alias("n"))
        .join(labels, "label_name", "left_anti")
    )


def label_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Label names of ``left`` that ``right`` does not have."""
    return left.select("label_name").distinct().exceptAll(right.select("label_name").distinct())


def check_label_map(labels: DataFrame) -> None:
    """Reject a map that is empty or whose ids are not unique and contiguous from 0."""
    row = labels.agg(
        F.count(F.lit(1)).alias("n"), F.count("label_name").alias("named"),
        F.countDistinct("label_name").alias("names"),
        F.countDistinct("label").alias("ids"), F.min("label").alias("low"), F.max("label").alias("high"),
    ).first()
    if row.n == 0:
        raise ValueError("the label map is empty")
    if row.named < row.n or row.names < row.n:
        raise ValueError("label names must be present and unique")
    if row.ids < row.n or row.low != 0 or row.high != row.n - 1:
        raise ValueError(f"label ids must be unique and run from 0 to {row.n - 1}")


def external_test(scanned: DataFrame, processed: DataFrame, labels: DataFrame) -> DataFrame:
    """Label a test set by a given map; unknown labels are an error, not skipped.

    ``scanned`` has a row per input flow, ``processed`` a row per flow that gave
    a sample. Labels of the map without a test flow give a warning. Each side is read once, for its labels.
    """
    check_label_map(labels)
    known = labels.select("label_name", F.lit(True).alias("known"))
    seen = scanned.groupBy("label_name").agg(F.count(F.lit(1)).alias("n"))
    # One row for each label; only those of one side come to the driver.
    both = known.join(seen, F.col("known") & known["label_name"].eqNullSafe(seen["label_name"]), "full_outer").select(
        F.when(F.col("known"), known["label_name"]).otherwise(seen["label_name"]).alias("label_name"), "known", "n")
    sides = both.agg(
        F.count("n").alias("scanned"), F.collect_list(F.when(F.col("known").isNull(), F.struct("label_name"))).alias("unknown"),
        F.collect_list(F.when(F.col("n").isNull(), F.col("label_name"))).alias("missing")).first()
    if not sides.scanned:
        raise ValueError("the external test set has no captures")
    if sides.unknown:
        raise ValueError(f"labels absent from the map: {sorted(str(r.label_name) for r in sides.unknown)}")
    if sides.missing:
        warnings.warn(f"labels without a test flow: {sorted(sides.missing)}", stacklevel=2)
    if processed.isEmpty():
        raise ValueError("no capture of the external test set could be processed")
    return attach_label_id(processed, labels)



def extraction_report(scanned: DataFrame, processed: DataFrame) -> DataFrame:
    """Per label: scanned, processed and failed."""
    seen = scanned.groupBy("label_name").agg(F.count(F.lit(1)).alias("scanned"))
    done = processed.groupBy("label_name").agg(F.count(F.lit(1)).alias("_done"))
    count = F.coalesce("_done", F.lit(0))
    return seen.join(done, "label_name", "left").select(
        "label_name", "scanned", count.alias("processed"), (F.col("scanned") - count).alias("failed")
    )


def few_shot(samples: DataFrame, ratio: float, seed=42, ident: str = "flow_key") -> DataFrame:
    """Per class keep min(n, max(1, int(n * ratio))) samples."""
    k = F.least(
        F.col("class_total"),
        F.greatest(F.lit(1), F.floor(F.col("class_total") * F.lit(float(ratio)))),
    )
    return _ranked(samples, seed, ident, "few", F.col("rank") < k).drop("rank", "class_total")


def few_shot_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after, and the percentage kept."""
    tagged = before.select(F.lit(0).alias("kept")).unionAll(after.select(F.lit(1).alias("kept")))
    n = tagged.agg(
        F.count(F.when(F.col("kept") == 0, 1)).alias("before"), F.count(F.when(F.col("kept") == 1, 1)).alias("after")
    )
    share = F.round(F.col("after") / F.greatest(F.col("before"), F.lit(1)) * 100, 1)
    return n.withColumn("percent", share)


def union_parts(*parts: DataFrame) -> DataFrame:
    """Concatenate parts by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
