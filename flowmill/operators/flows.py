"""Flow assembly and per-flow sequences.

A flow is both directions of one conversation inside one capture. Its packets
may be a large share of all rows, so nothing here sorts or collects a whole
flow: a flow is cut into chunks of the packet order, each chunk is summarised
map-side, the short list of chunk summaries is scanned per flow, and each packet
then gets its rank and predecessor from its own chunk plus that summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.operators.packets import (
    byte_tokens, capped_size, flow_name, raw_head, signed_size_token,
)

# Fixed values.
MIN_GAP, IAT_BINS = 1e-6, 1000
MIN_PAYLOAD_PACKETS = 5
CHUNK = 1 << 20


ENDS = ("lo_ip", "lo_port", "hi_ip", "hi_port")


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Add the two endpoints in a fixed order, ``flow_key`` and ``forward``.

    ``flow_key`` is equal for both directions. ``forward`` tells whether the
    packet goes from the lower endpoint to the higher one; it stands for the
    direction until the initiator is known.
    """
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    low, high = F.least(src, dst), F.greatest(src, dst)
    return packets.withColumns({
        "lo_ip": low["ip"], "lo_port": low["port"], "hi_ip": high["ip"], "hi_port": high["port"],
        "forward": src <= dst,
    }).withColumn("flow_key", F.concat_ws("|", "capture", "proto", *ENDS))


def _chunk_summaries(keyed: DataFrame) -> DataFrame:
    """One row per (flow, chunk): what earlier chunks mean for this one.

    All aggregates are fixed-width, so both steps stay hash aggregates.
    """
    paid = F.col("len") > 0
    declared = F.col("declared_len" if "declared_len" in keyed.columns else "len") > 0
    parts = keyed.groupBy("flow_key", "chunk").agg(
        F.count(F.lit(1)).alias("_packets"),
        F.count(F.when(paid, 1)).alias("_paid"),
        F.count(F.when(declared, 1)).alias("_declared"),
        F.min_by("forward", "seq").alias("_first"),
        F.max_by(F.when(paid, F.col("t")), F.when(paid, F.col("seq"))).alias("_last_t"),
    )
    flow = Window.partitionBy("flow_key")
    ordered = flow.orderBy("chunk")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(
        "flow_key", "chunk",
        F.sum("_packets").over(flow).alias("n_packets"),
        F.sum("_declared").over(flow).alias("n_payload"),
        F.coalesce(F.sum("_paid").over(before), F.lit(0)).alias("_offset"),
        F.last("_last_t", ignorenulls=True).over(before).alias("_prev_t"),
        F.first("_first").over(
            ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ).alias("_first"),
    )


def flow_table(packets: DataFrame) -> DataFrame:
    """One row per flow: name, initiator, packet and payload-packet counts.

    A plain two-step hash aggregate; a hot flow is combined map-side. Payload packets are
    counted by the length the headers declare, where there is one: a snapped capture keeps its flows.
    """
    keyed = with_flow_key(packets)
    size = F.col("declared_len" if "declared_len" in packets.columns else "len")
    extra = [c for c in ("capture", "label", "proto") if c in packets.columns]
    grouped = keyed.groupBy("flow_key", *extra, *ENDS).agg(
        F.count(F.lit(1)).alias("n_packets"),
        F.count(F.when(size > 0, 1)).alias("n_payload"),
        F.min_by("forward", "seq").alias("_forward"),
    )

    def end(near, far):
        return F.when(F.col("_forward"), F.col(near)).otherwise(F.col(far))

    named = grouped.withColumns({
        "cli_ip": end("lo_ip", "hi_ip"), "cli_port": end("lo_port", "hi_port"),
        "srv_ip": end("hi_ip", "lo_ip"), "srv_port": end("hi_port", "lo_port"),
    }).drop("_forward", *ENDS)
    return named.withColumn("file_name", flow_name(
        F.col("proto"), F.col("cli_ip"), F.col("cli_port"), F.col("srv_ip"), F.col("srv_port")
    ))


def assemble_flows(
    packets: DataFrame, min_payload: int = MIN_PAYLOAD_PACKETS, chunk: int = CHUNK
) -> DataFrame:
    """Attach each packet to its flow: initiator, direction, counts.

    Flows with fewer than ``min_payload`` payload packets are dropped; kept flows
    keep all their packets. The join is on (flow, chunk), so no key holds more
    than ``chunk`` rows.
    """
    keyed = with_flow_key(packets).withColumn("chunk", F.expr(f"seq div {chunk}"))
    about = _chunk_summaries(keyed).filter(F.col("n_payload") >= min_payload)
    up = F.col("forward") == F.col("_first")

    def end(near, far):
        return F.when(up, F.col(near)).otherwise(F.col(far))

    return (
        keyed.join(about, ["flow_key", "chunk"])
        .withColumns({
            "cli_ip": end("src_ip", "dst_ip"), "cli_port": end("src_port", "dst_port"),
            "srv_ip": end("dst_ip", "src_ip"), "srv_port": end("dst_port", "src_port"),
            "direction": F.when(up, 1).otherwise(-1),
        })
        .drop("_first", "forward", *ENDS)
    )


def packet_direction(ip: Column, port: Column, cli_ip: Column, cli_port: Column) -> Column:
    return F.when((ip == cli_ip) & (port == cli_port), 1).otherwise(-1)


def payload_packets(
    flows: DataFrame, *, max_packets: int | None = None,
) -> DataFrame:
    """Payload packets of assembled flows with ``rank`` (0-based) and ``gap``.

    ``max_packets`` drops later packets before anything is sorted.
    """
    paid = flows.filter(F.col("len") > 0)
    if max_packets is not None:
        paid = paid.filter(F.col("_offset") < max_packets)
    here = Window.partitionBy("flow_key", "chunk").orderBy("seq")
    ranked = paid.withColumns({
        "rank": (F.col("_offset") + F.row_number().over(here) - 1).cast("bigint"),
        "gap": inter_arrival(F.col("t"), F.coalesce(F.lag("t").over(here), F.col("_prev_t"))),
    })
    if max_packets is not None:
        ranked = ranked.filter(F.col("rank") < max_packets)
    return ranked.drop("_offset", "_prev_t")


def inter_arrival(t: Column, previous: Column) -> Column:
    """Seconds since the previous payload packet, at least 1e-6; first packet 1e-6."""
    return F.greatest(F.coalesce(t - previous, F.lit(MIN_GAP)), F.lit(MIN_GAP))


def iat_token(gap: Column) -> Column:
    """Bin 0..999 of the sigmoid of log10(gap)."""
    squashed = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.log10(gap)))
    return F.least(
        F.greatest(F.floor(squashed * IAT_BINS), F.lit(0)), F.lit(IAT_BINS - 1)
    ).cast("int")


def slim(packets: DataFrame, nbytes: int = 64) -> DataFrame:
    """Packets with the first ``nbytes`` of payload in place of the whole of it.

    Applied before flows are assembled, so shuffles carry no more than that.
    """
    return packets.withColumn("head", raw_head(F.col("payload"), nbytes)).drop("payload")


def flow_tokens(
    flows: DataFrame, *, max_packets: int | None = None, max_raw: int = 8
) -> DataFrame:
    """One row per payload packet with its size token, IAT token and first bytes.

    ``flows`` is :func:`assemble_flows` of :func:`slim` packets; the bytes are
    kept for the first ``max_raw`` packets only.
    """
    ranked = payload_packets(flows, max_packets=max_packets)
    size = capped_size(F.col("len"))
    return ranked.withColumns({
        "size_token": signed_size_token(size, F.col("direction")),
        "iat_token": iat_token(F.col("gap")),
        "head": F.when(F.col("rank") < max_raw, F.col("head")),
    })


FLOW_COLUMNS = ("capture", "label", "proto", "cli_ip", "cli_port", "srv_ip", "srv_port", "n_payload")


def flow_sequences(tokens: DataFrame, max_packets: int = 256) -> DataFrame:
    """One row per flow: raw packets, size tokens and IAT tokens in packet order.

    ``tokens`` comes from :func:`flow_tokens`; at most ``max_packets`` entries
    are collected per flow, so a group is bounded. Unbounded size sequences are
    kept as chunks by :func:`size_chunks`.
    """
    columns = [c for c in FLOW_COLUMNS if c in tokens.columns]
    rows = tokens.filter(F.col("rank") < max_packets)
    entry = F.struct("rank", "direction", "size_token", "iat_token", "head")
    grouped = rows.groupBy("flow_key").agg(
        F.sort_array(F.collect_list(entry)).alias("_seq"),
        *[F.min(c).alias(c) for c in columns],
    )
    heads = F.filter("_seq", lambda x: x["head"].isNotNull())
    return grouped.select(
        "flow_key", *columns,
        F.transform(
            heads,
            lambda x: F.struct(
                x["direction"].alias("direction"), byte_tokens(x["head"]).alias("tokens")
            ),
        ).alias("packets"),
        F.transform("_seq", lambda x: x["size_token"]).alias("size_tokens"),
        F.transform("_seq", lambda x: x["iat_token"]).alias("iat_tokens"),
    )


def size_chunks(tokens: DataFrame, per_chunk: int = 65536) -> DataFrame:
    """Whole size and IAT sequences, ``per_chunk`` packets per row."""
    entry = F.struct("rank", "size_token", "iat_token")
    columns = [c for c in ("capture", "label", "proto") if c in tokens.columns]
    return (
        tokens.groupBy("flow_key", F.expr(f"rank div {per_chunk}").alias("part"))
        .agg(F.sort_array(F.collect_list(entry)).alias("_seq"),
             *[F.min(c).alias(c) for c in columns])
        .select(
            "flow_key", *columns, "part",
            F.transform("_seq", lambda x: x["size_token"]).alias("size_tokens"),
            F.transform("_seq", lambda x: x["iat_token"]).alias("iat_tokens"),
        )
    )


def files_per_label(flows: DataFrame) -> DataFrame:
    """(label, files): flow files that an export writes for each label, most first in any display.

    ``flows`` has a row per kept flow, with ``label`` and ``file_name``; flows of one file count once.
    """
    files = flows.select("label", "capture", "file_name").distinct()
    return files.groupBy("label").agg(F.count(F.lit(1)).alias("files"))


def split_report(packets: DataFrame, min_payload: int = MIN_PAYLOAD_PACKETS) -> DataFrame:
    """Per capture: flows found and flows kept."""
    flows = flow_table(packets)
    return flows.groupBy("capture").agg(
        F.count(F.lit(1)).alias("flows_found"),
        F.count(F.when(F.col("n_payload") >= min_payload, 1)).alias("flows_valid"),
    )
