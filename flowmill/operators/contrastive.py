"""In-batch similarities between two modalities and the pairs drawn from them.

A batch has a fixed small size, so its vectors fit in one row; similarities are
kept as one array per sample and never spread out as rows of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions.arrays import dot, let, log_sum_exp, norm
from flowmill.functions.rng import uniform_open

# Fixed values.
TEMPERATURE, SIGMA, RESERVED = 0.07, 10, 5
TINY = 1e-12


def normalize(vector: Column) -> Column:
    """Scale to unit length; a zero vector stays zero."""
    return let(
        vector,
        lambda v: let(
            F.greatest(norm(v), F.lit(TINY)), lambda n: F.transform(v, lambda x: x / n)
        ),
    )


def batch_similarity(df: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Per sample: its similarities to every member of its batch, both ways.

    Needs batch_id, id, raw and size (unit vectors); with a ``shard`` column, batches are
    those of a shard. Adds ``ids`` (members in
    order), ``place`` (the sample's own index, from 1), ``raw_to_size`` and
    ``size_to_raw``. One shuffle, on the batch.
    """
    batch = [c for c in ("shard", "batch_id") if c in df.columns]
    pool = df.groupBy(*batch).agg(
        F.sort_array(F.collect_list(F.struct("id", "raw", "size"))).alias("pool")
    )

    def row(members, me, i):
        return F.struct(
            me["id"].alias("id"), (i + 1).cast("int").alias("place"),
            F.transform(members, lambda o: dot(me["raw"], o["size"]) / temperature).alias("raw_to_size"),
            F.transform(members, lambda o: dot(me["size"], o["raw"]) / temperature).alias("size_to_raw"),
        )

    rows = let(F.col("pool"), lambda m: F.transform(m, lambda me, i: row(m, me, i)))
    return pool.select(
        *batch, F.transform("pool", lambda m: m["id"]).alias("ids"), F.explode_outer(rows).alias("r")
    ).select(*batch, "ids", "r.*")


def infonce_loss(similarities: DataFrame) -> DataFrame:
    """Per batch: mean of logsumexp minus the own similarity, both ways averaged."""
    def side(name):
        return log_sum_exp(F.col(name)) - F.element_at(name, F.col("place"))

    batch = [c for c in ("shard", "batch_id") if c in similarities.columns]
    return similarities.groupBy(*batch).agg(
        ((F.avg(side("raw_to_size")) + F.avg(side("size_to_raw"))) / 2).alias("loss")
    )


def hard_negative_sampling(similarities: DataFrame, seed=7) -> DataFrame:
    """Per sample one other member per way, drawn with probability softmax(similarity).

    The largest of similarity plus Gumbel noise is exactly such a draw.
    """
    def draw(name, purpose):
        def score(s, j):
            u = uniform_open(seed, purpose, F.col("id"), j)
            return F.struct((s - F.ln(-F.ln(u))).alias("score"), j.alias("j"))

        scores = F.zip_with(name, "ids", score)
        others = F.filter(scores, lambda x: x["j"] != F.col("id"))
        return F.array_max(others)["j"]

    return similarities.select(
        "batch_id", "id", draw("raw_to_size", "size").alias("neg_size"),
        draw("size_to_raw", "raw").alias("neg_raw"),
    )


def matching_pairs(negatives: DataFrame) -> DataFrame:
    """Three rows per sample: its own pair (1) and one mismatch per way (0)."""
    def pair(raw, size, match):
        return F.struct(F.col(raw).alias("raw_id"), F.col(size).alias("size_id"), F.lit(match).alias("match"))

    rows = F.array(pair("id", "id", 1), pair("id", "neg_size", 0), pair("neg_raw", "id", 0))
    return negatives.select("batch_id", F.inline(rows)).filter(
        F.col("raw_id").isNotNull() & F.col("size_id").isNotNull()
    )


def gaussian_soft_labels(target: Column, classes: int, sigma: float = SIGMA, reserved: int = RESERVED) -> Column:
    """Weights over ids, bell-shaped around the target, reserved ids 0, sum 1."""
    bell = F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda x: F.when(
            x >= reserved, F.exp(-((x - target) * (x - target)).cast("double") / (2.0 * sigma * sigma))
        ).otherwise(F.lit(0.0)),
    )
    return let(bell, lambda w: let(
        F.aggregate(w, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(w, lambda x: x / total)
    ))


def soft_label_loss(logits: Column, target: Column, classes: int, sigma: float = SIGMA) -> Column:
    """Cross entropy of the logits against the soft labels."""
    return let(logits, lambda z: let(log_sum_exp(z), lambda top: -F.aggregate(
        F.zip_with(gaussian_soft_labels(target, classes, sigma), z, lambda w, x: w * (x - top)),
        F.lit(0.0), lambda s, x: s + x,
    )))
