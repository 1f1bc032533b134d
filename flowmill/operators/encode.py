"""Token ids and fixed-length instances. Every operator here is a projection: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions.arrays import frame_with, no_ints
from flowmill.operators.packets import clamp_id, direction_index

# Reserved ids, vocabulary sizes, lengths.
PAD, UNK, CLS, SEP, MASK = 0, 1, 2, 3, 4
RESERVED = 5
VOCAB_RAW, VOCAB_SIZE, VOCAB_IAT = 261, 3006, 1005
LENGTH_RAW, LENGTH_SIZE = 512, 256
MAX_RAW_PACKETS, NO_PACKET, NO_DIRECTION = 8, 8, 1


def byte_ids(tokens: Column) -> Column:
    """Two-digit hex tokens -> ids; the byte vocabulary is 5 + byte value, others are [UNK]."""
    return F.transform(tokens, lambda t: F.when(
        F.rlike(t, F.lit("^[0-9a-f]{2}$")), F.conv(t, 16, 10).cast("int") + RESERVED).otherwise(UNK).cast("int"))


def shifted_ids(tokens: Column, vocab_size: int) -> Column:
    """Size and IAT tokens -> ids: 5 + token, kept inside the vocabulary; null is [UNK]."""
    return F.transform(tokens, lambda t: F.when(t.isNull(), UNK).otherwise(
        clamp_id((t + RESERVED).cast("int"), vocab_size)).cast("int"))


def _flat(packets: Column, each) -> Column:
    """Concatenate ``each(packet, index)`` over the first eight packets."""
    head = F.slice(packets, 1, MAX_RAW_PACKETS)
    return F.when(F.size(head) > 0, F.flatten(F.transform(head, each))).otherwise(no_ints())


def raw_ids(packets: Column) -> Column:
    return _flat(packets, lambda p, i: byte_ids(p["tokens"]))


def raw_packet_index(packets: Column) -> Column:
    return _flat(packets, lambda p, i: F.array_repeat(i.cast("int"), F.size(p["tokens"])))


def raw_direction_index(packets: Column) -> Column:
    return _flat(
        packets,
        lambda p, i: F.array_repeat(direction_index(p["direction"]).cast("int"), F.size(p["tokens"])),
    )


def encode_raw(df: DataFrame, length: int = LENGTH_RAW) -> DataFrame:
    """Add src, packet_ids, directions of ``length`` from ``packets``."""
    p = F.col("packets")
    return df.withColumns({
        "src": frame_with(raw_ids(p), length, CLS, SEP, PAD),
        "packet_ids": frame_with(raw_packet_index(p), length, NO_PACKET, NO_PACKET, NO_PACKET),
        "directions": frame_with(
            raw_direction_index(p), length, NO_DIRECTION, NO_DIRECTION, NO_DIRECTION
        ),
    })


def encode_size_iat(df: DataFrame, length: int = LENGTH_SIZE) -> DataFrame:
    """Add src_size and src_iat of ``length``, both cut to the shorter sequence."""
    n = F.least(F.size("size_tokens"), F.size("iat_tokens"))
    size = shifted_ids(F.slice("size_tokens", 1, F.least(n, F.lit(length - 2))), VOCAB_SIZE)
    iat = shifted_ids(F.slice("iat_tokens", 1, F.least(n, F.lit(length - 2))), VOCAB_IAT)
    return df.withColumns({
        "src_size": frame_with(size, length, CLS, SEP, PAD),
        "src_iat": frame_with(iat, length, CLS, SEP, PAD),
    })


def paired_instance(df: DataFrame) -> DataFrame:
    """Both modalities of a flow in one row."""
    return encode_size_iat(encode_raw(df))


def token_positions(df: DataFrame, length: int = LENGTH_RAW) -> DataFrame:
    """One row per raw token: packet index and running position, cut at length - 2."""
    p = F.col("packets")
    pair = F.arrays_zip(
        F.slice(raw_packet_index(p), 1, length - 2).alias("packet"),
        F.slice(raw_ids(p), 1, length - 2).alias("token"),
    )
    return df.select("flow_key", F.posexplode_outer(pair).alias("position", "_x")).select(
        "flow_key", "position", F.col("_x.packet").alias("packet"), F.col("_x.token").alias("token")
    )


def duplicate_instances(df: DataFrame, factor: int = 5) -> DataFrame:
    """Each row ``factor`` times, numbered by ``dup``."""
    return df.withColumn("dup", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
