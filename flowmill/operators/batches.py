"""Ordinals, shards and batches of a shuffled dataset, exact at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.functions.ranking import hash_bucket, with_rank
from flowmill.functions.rng import hash_key


def shuffle(df: DataFrame, ident: list[str], seed=7, epoch: int = 0, rank: str = "ordinal") -> DataFrame:
    """Random order as a column: the ordinal of each row in the epoch's order.

    A reader that needs the rows physically in that order sorts by it on export.
    """
    key = hash_key(seed, "shuffle", epoch, *[F.col(c) for c in ident])
    keyed = df.withColumn("_key", key)
    return with_rank(
        keyed, [], [F.col("_key")], hash_bucket(F.col("_key")), rank=rank, total="total", once=True
    ).drop("_key")


def round_robin_shard(shuffled: DataFrame, shards: int, epoch: int = 0) -> DataFrame:
    """Row i goes to shard i mod n; the count runs on over epochs, so shards rotate."""
    return shuffled.withColumn(
        "shard", F.pmod(F.lit(epoch) * F.col("total") + F.col("ordinal"), F.lit(shards)).cast("int")
    )


def batch_id(sharded: DataFrame, batch_size: int, shards: int, epoch: int = 0) -> DataFrame:
    """Consecutive groups of ``batch_size`` within a shard; the last short one is kept.

    A shard holds every ``shards``-th ordinal, so the place within it is
    arithmetic and needs no second ranking.
    """
    first = F.pmod(F.col("shard") - F.lit(epoch) * F.col("total"), F.lit(shards))
    place = F.floor((F.col("ordinal") - first) / shards)
    return sharded.withColumn("batch_id", F.floor(place / batch_size).cast("bigint"))
