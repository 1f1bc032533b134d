"""Captures, decoding and packet-level columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill import fixtures as fx
from flowmill.operators import flows as fl
from flowmill.operators import packets as pkt
from flowmill.plans.oracle import define
from flowmill.plans.registry import query
from flowmill.session import shared_folder
from flowmill.sources import captures as cap

PER_FILE, HEAD = 65536, 64


def with_file(frames):
    """Capture files as a recorder rotates them: per site, every 65,536 records."""
    part = F.concat(F.lit("part"), F.expr(f"seq div {PER_FILE}"))
    site = (
        F.when(F.col("capture") == 0, F.concat(F.lit("site0/"), part, F.lit(".pcap")))
        .when(F.col("capture") == 1, F.concat(F.lit("site1/inner/"), part, F.lit(".PCAP")))
        .otherwise(F.concat(part, F.lit(".pcap")))
    )
    return frames.withColumn("file", site)


def stored_captures(spark, sf_dir, change=lambda p: p, snap=None):
    """Write the packet view as capture files; returns their folder."""
    root = shared_folder(spark, "captures")
    frames = fx.frames(change(fx.packets(spark, sf_dir)))
    if snap:
        frames = frames.withColumn("frame", F.substring("frame", 1, snap))
    cap.write_captures(with_file(frames), root)
    return root


define("filed", """
  select *, case capture when 0 then 'site0' when 1 then 'site1/inner' else 'unlabeled' end as label_dir,
         concat('part', seq // 65536) stem,
         case capture when 0 then 1 when 1 then 101 else 113 end linktype,
         case capture when 0 then 14 when 1 then 0 else 16 end + 20 + if(proto = 6, 20, 8) header
  from packets
""", "packets")


@query("capture_listing", """
  select label_dir as label, stem, cast(24 + sum(16 + header + len) as bigint) as bytes
  from filed group by all
""", "filed")
def capture_listing(spark, sf_dir):
    return cap.capture_listing(spark, stored_captures(spark, sf_dir)).select(
        "label", "stem", F.col("length").alias("bytes")
    )


@query("read_captures", """
  select label_dir as label, stem, ts_us, linktype, cast(header + len as bigint) origlen,
         cast(24 + sum(16 + header + len) over (partition by label_dir, stem order by seq)
              - (16 + header + len) as bigint) as seq
  from filed
""", "filed")
def read_captures(spark, sf_dir):
    # Small splits, so that the range proof is exercised.
    packets = cap.read_captures(spark, stored_captures(spark, sf_dir), split_bytes=1 << 18)
    return packets.select("label", "stem", "ts_us", "linktype", "origlen", "seq")


@query("write_flow_captures", """
  select concat(label_dir, '/', stem) as label,
         concat(if(min(proto) = 6, 'TCP', 'UDP'), '_', min(cli_ip), '_', min(cli_port), '_',
                min(srv_ip), '_', min(srv_port)) stem,
         cast(24 + sum(16 + header + len) as bigint) as bytes
  from (select *, first(src_ip) over w cli_ip, first(src_port) over w cli_port,
               first(dst_ip) over w srv_ip, first(dst_port) over w srv_port,
               sum(case when len > 0 then 1 else 0 end) over (partition by label_dir, stem, flow_key) n
        from (select f.*, k.flow_key from filed f join keyed k using (seq))
        window w as (partition by label_dir, stem, flow_key order by seq))
  where n >= 5
  group by label_dir, stem, flow_key
""", "filed", "keyed")
def write_flow_captures(spark, sf_dir):
    packets = cap.read_captures(spark, stored_captures(spark, sf_dir))
    decoded = pkt.drop_udp_dns(pkt.decode_packets(packets, keep_payload=False, keep_frame=True))
    out = shared_folder(spark, "flow-captures")
    cap.write_flow_captures(fl.assemble_flows(decoded), out)
    return cap.capture_listing(spark, out).select("label", "stem", F.col("length").alias("bytes"))


DECODED = ["label", "stem", "ts_us", "proto", "src_ip", "src_port", "dst_ip", "dst_port", "len"]


@query("decode_packets", """
  select label_dir as label, stem, ts_us, proto, src_ip, src_port, dst_ip, dst_port, len,
         md5(payload_hex) payload_md5
  from filed
""", "filed")
def decode_packets(spark, sf_dir):
    packets = pkt.decode_packets(cap.read_captures(spark, stored_captures(spark, sf_dir)))
    return packets.select(*DECODED, F.md5(F.hex("payload")).alias("payload_md5"))


@query("ipv4_tcp_udp_filter", """
  select label_dir as label, proto, cast(count(*) as bigint) n, cast(sum(len) as bigint) payload_bytes
  from filed where svc <> 3 group by all
""", "filed")
def ipv4_tcp_udp_filter(spark, sf_dir):
    # Service 3 is sent as ICMP (protocol 1) and must vanish on decoding.
    icmp = lambda p: p.withColumn("proto", F.when(F.col("svc") == 3, 1).otherwise(F.col("proto")))
    packets = pkt.decode_packets(
        cap.read_captures(spark, stored_captures(spark, sf_dir, icmp)), keep_payload=False
    )
    return (
        pkt.ipv4_tcp_udp(packets).groupBy("label", "proto")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("payload_bytes"))
    )


@query("drop_udp_dns", "select seq, capture, proto, src_port, dst_port, len from kept", "kept")
def drop_udp_dns(spark, sf_dir):
    return pkt.drop_udp_dns(fx.packets(spark, sf_dir)).select(
        "seq", "capture", "proto", "src_port", "dst_port", "len"
    )


@query("payload_flag", """
  select label_dir as label, stem, ts_us, proto, len > 0 has_payload,
         cast(least(len, greatest(0, 60 - header)) as int) captured
  from filed
""", "filed")
def payload_flag(spark, sf_dir):
    # Frames snapped to 60 bytes: the flag goes by the header, not by what was captured.
    packets = cap.read_captures(spark, stored_captures(spark, sf_dir, snap=60))
    return pkt.decode_packets(packets).select(
        "label", "stem", "ts_us", "proto",
        pkt.has_payload(F.col("declared_len")).alias("has_payload"), F.col("len").alias("captured"),
    )


def kept(spark, sf_dir, nbytes=None):
    return pkt.drop_udp_dns(fx.packets(spark, sf_dir, nbytes))


def assembled(spark, sf_dir):
    return fl.assemble_flows(kept(spark, sf_dir))


def tokens(spark, sf_dir, **options):
    return fl.flow_tokens(fl.assemble_flows(fl.slim(kept(spark, sf_dir, HEAD), HEAD)), **options)


@query("min_payload_packets", "select seq, flow_key, len, n_payload from assembled", "assembled")
def min_payload_packets(spark, sf_dir):
    return assembled(spark, sf_dir).select("seq", "flow_key", "len", "n_payload")


@query("nonempty_payload", "select seq, len, md5(payload_hex) payload_md5 from packets where len > 0", "packets")
def nonempty_payload(spark, sf_dir):
    rows = pkt.nonempty_payload(fx.packets(spark, sf_dir))
    return rows.select("seq", "len", F.md5(F.hex("payload")).alias("payload_md5"))


@query("payload_size_cap", "select seq, cast(least(len, 1500) as int) size from packets", "packets")
def payload_size_cap(spark, sf_dir):
    return fx.packets(spark, sf_dir).select("seq", pkt.capped_size(F.col("len")).alias("size"))


@query("raw_head", """
  select seq, cast(rank as bigint) as rank, head_hex as head from tokens where rank < 8
""", "tokens")
def raw_head(spark, sf_dir):
    rows = tokens(spark, sf_dir, max_packets=8)
    return rows.select("seq", "rank", F.lower(F.hex("head")).alias("head"))


@query("size_head", """
  select seq, cast(rank as bigint) as rank, size_token from tokens where rank < 8
""", "tokens")
def size_head(spark, sf_dir):
    return tokens(spark, sf_dir, max_packets=8).select("seq", "rank", "size_token")


@query("parse_flow_name", """
  select file_name, proto, cli_ip, cli_port, srv_ip, srv_port from flow_list
""", "flow_list")
def parse_flow_name(spark, sf_dir):
    names = fl.flow_table(kept(spark, sf_dir)).select("file_name")
    return pkt.parse_flow_name(names)


@query("packet_direction", "select seq, direction from assembled", "assembled")
def packet_direction(spark, sf_dir):
    d = fl.packet_direction(F.col("src_ip"), F.col("src_port"), F.col("cli_ip"), F.col("cli_port"))
    return assembled(spark, sf_dir).select("seq", d.alias("direction"))


@query("byte_tokens", """
  select seq, trim(regexp_replace(lower(payload_hex), '(..)', '\\1 ', 'g')) as tokens from packets
""", "packets")
def byte_tokens(spark, sf_dir):
    return fx.packets(spark, sf_dir).select(
        "seq", F.array_join(pkt.byte_tokens(F.col("payload")), " ").alias("tokens")
    )


@query("signed_size_token", "select seq, size_token from tokens", "tokens")
def signed_size_token(spark, sf_dir):
    rows = pkt.nonempty_payload(assembled(spark, sf_dir))
    size = pkt.capped_size(F.col("len"))
    return rows.select("seq", pkt.signed_size_token(size, F.col("direction")).alias("size_token"))


@query("protocol_code", "select seq, case when proto = 6 then 0 else 1 end protocol from packets", "packets")
def protocol_code(spark, sf_dir):
    return fx.packets(spark, sf_dir).select("seq", pkt.protocol_code(F.col("proto")).alias("protocol"))


@query("direction_index", "select seq, case when direction = -1 then 0 else 2 end direction from assembled", "assembled")
def direction_index(spark, sf_dir):
    return assembled(spark, sf_dir).select(
        "seq", pkt.direction_index(F.col("direction")).alias("direction")
    )


@query("clamp_token_ids", """
  select seq, cast(least(greatest(size_token + 5, 0), 1600 - 1) as int) id from tokens
""", "tokens")
def clamp_token_ids(spark, sf_dir):
    # A vocabulary of 1,600 ids, shorter than the tokens need.
    return tokens(spark, sf_dir).select(
        "seq", pkt.clamp_id(F.col("size_token") + 5, 1600).alias("id")
    )
