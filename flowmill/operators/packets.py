"""Packet-level decoding, filters and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions.arrays import big_endian, hex_tokens

# Fixed values.
TCP, UDP, DNS_PORT, ETHERTYPE_IPV4 = 6, 17, 53, 0x0800
MAX_PAYLOAD, SIZE_SHIFT = 1500, 1500
LINK_ETHERNET, LINK_RAW, LINK_RAW_ALT, LINK_SLL, LINK_IPV4 = 1, 12, 101, 113, 228


def ip_offset(frame: Column, linktype: Column, caplen: Column) -> Column:
    """Where the IPv4 header starts; null when the frame does not carry IPv4."""
    ethernet = (
        (linktype == LINK_ETHERNET) & (caplen >= 14)
        & (big_endian(frame, 12, 2) == ETHERTYPE_IPV4)
    )
    cooked = (
        (linktype == LINK_SLL) & (caplen >= 16)
        & (big_endian(frame, 14, 2) == ETHERTYPE_IPV4)
    )
    return (
        F.when(ethernet, 14).when(cooked, 16)
        .when(linktype.isin(LINK_RAW, LINK_RAW_ALT, LINK_IPV4), 0)
    )


def decode_packets(
    frames: DataFrame, keep_payload: bool = True, keep_frame: bool = False
) -> DataFrame:
    """Frames -> IPv4 TCP/UDP packets; every other frame is dropped.

    Adds proto, endpoints, ``len`` (payload bytes by the IP header's length,
    cut to what was captured) and ``payload``. The header length rules, so that
    link padding is not payload.
    """
    cap = F.octet_length("frame")
    step = frames.withColumn("_ip", ip_offset(F.col("frame"), F.col("linktype"), cap))
    step = step.filter(F.col("_ip").isNotNull() & (cap >= F.col("_ip") + 20))
    frame, ip = F.col("frame"), F.col("_ip")
    first = big_endian(frame, ip, 1)
    step = step.withColumns({
        "proto": big_endian(frame, ip + 9, 1).cast("int"),
        "_version": F.shiftright(first, 4),
        "_l4": (ip + (first.bitwiseAND(F.lit(15)) * 4)).cast("int"),
        "_total": big_endian(frame, ip + 2, 2),
    })
    need = F.when(F.col("proto") == TCP, 20).when(F.col("proto") == UDP, 8)
    step = step.filter(
        (F.col("_version") == 4) & F.col("proto").isin(TCP, UDP) & (cap >= F.col("_l4") + need)
    )
    l4 = F.col("_l4")
    header = F.when(
        F.col("proto") == TCP, F.shiftright(big_endian(frame, l4 + 12, 1), 4) * 4
    ).otherwise(8)

    def dotted(at):
        return F.concat_ws(".", *[big_endian(frame, ip + at + i, 1).cast("string") for i in range(4)])

    declared = (F.col("_total") - (l4 - ip) - header).cast("int")
    step = step.withColumns({
        "src_ip": dotted(12), "dst_ip": dotted(16),
        "src_port": big_endian(frame, l4, 2).cast("int"),
        "dst_port": big_endian(frame, l4 + 2, 2).cast("int"),
        "declared_len": declared,
        "len": F.greatest(F.lit(0), F.least(declared, cap - l4 - header)).cast("int"),
        "_at": (l4 + header + 1).cast("int"),
    })
    if keep_payload:
        step = step.withColumn("payload", F.substring(frame, F.col("_at"), F.col("len")))
    step = step.drop("_ip", "_version", "_l4", "_total", "_at")
    return step if keep_frame else step.drop("frame")


def ipv4_tcp_udp(packets: DataFrame) -> DataFrame:
    return packets.filter(F.col("proto").isin(TCP, UDP))


def drop_udp_dns(packets: DataFrame) -> DataFrame:
    dns = (F.col("src_port") == DNS_PORT) | (F.col("dst_port") == DNS_PORT)
    return packets.filter(~((F.col("proto") == UDP) & dns))


def has_payload(declared_len: Column) -> Column:
    """Payload flag by header length, whether or not those bytes were captured."""
    return declared_len > 0


def nonempty_payload(packets: DataFrame) -> DataFrame:
    return packets.filter(F.col("len") > 0)


def capped_size(length: Column) -> Column:
    return F.least(length, F.lit(MAX_PAYLOAD))


def raw_head(payload: Column, nbytes: int = 64) -> Column:
    return F.substring(payload, 1, nbytes)


def byte_tokens(payload: Column) -> Column:
    return hex_tokens(payload)


def signed_size_token(size: Column, direction: Column) -> Column:
    return (size * direction + SIZE_SHIFT).cast("int")


def protocol_code(proto: Column) -> Column:
    return F.when(proto == TCP, 0).otherwise(1)


def direction_index(direction: Column) -> Column:
    return F.when(direction == -1, 0).otherwise(2)


def clamp_id(token: Column, vocab_size: int) -> Column:
    return F.least(F.greatest(token, F.lit(0)), F.lit(vocab_size - 1))


def flow_name(proto: Column, ip1: Column, port1: Column, ip2: Column, port2: Column) -> Column:
    return F.concat(
        F.when(proto == TCP, "TCP").otherwise("UDP"), F.lit("_"), ip1, F.lit("_"), port1.cast("string"),
        F.lit("_"), ip2, F.lit("_"), port2.cast("string"), F.lit(".pcap"),
    )


def parse_flow_name(df: DataFrame, name: str = "file_name") -> DataFrame:
    """Protocol and endpoints from a flow file name; rows that do not parse are dropped.

    Both suffixes are accepted.
    """
    stem = F.regexp_replace(F.col(name), r"\.pcap(ng)?$", "")
    part = F.split(stem, "_")
    kind = F.lower(part[0])
    return (
        df.withColumn("_n", F.size(part))
        .withColumns({
            "proto": F.when(kind == "tcp", TCP).when(kind == "udp", UDP),
            "cli_ip": F.try_element_at(part, F.lit(2)),
            "cli_port": F.try_element_at(part, F.lit(3)).try_cast("int"),
            "srv_ip": F.try_element_at(part, F.lit(4)),
            "srv_port": F.try_element_at(part, F.lit(5)).try_cast("int"),
        })
        .filter(
            (F.col("_n") >= 5) & F.col("proto").isNotNull()
            & F.col("cli_port").isNotNull() & F.col("srv_port").isNotNull()
        )
        .drop("_n")
    )
