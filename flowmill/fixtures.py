"""Packet and capture views over the given tables.

Every event becomes one packet, and every byte of every document is carried by
exactly one packet: a document is cut into as many consecutive segments as it
has events, each fifth one empty (a packet without payload).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions.arrays import hex_fixed
from flowmill.functions.ranking import with_rank

PACKETS_SQL = """
with bodies as (
  select slot, encode(text, 'UTF-8') body, n_slots,
         cast((n_events - 1 - slot) div n_slots + 1 as int) pieces
  from {texts}),
cut as (
  select slot, n_slots, explode(transform(sequence(0, pieces - 1), i -> struct(
           i,
           substring(body,
                     cast((octet_length(body) * cast(i - i div 5 as bigint))
                          div (pieces - pieces div 5) as int) + 1,
                     cast((octet_length(body) * cast(i + 1 - (i + 1) div 5 as bigint))
                          div (pieces - pieces div 5)
                        - (octet_length(body) * cast(i - i div 5 as bigint))
                          div (pieces - pieces div 5) as int)) as payload))) piece
  from bodies),
segments as (
  select slot + piece.i * n_slots segment, {payload} payload, cast(octet_length(piece.payload) as int) len from cut),
sent as (
  select event_id, event_no, user_id, unix_micros(cast(ts as timestamp)) ts_us,
         cast(floor((day(ts) - 1) / 10.0D) as int) capture, cast(get_json_object(props, '$.k') as int) k,
         event_type in ('click', 'signup', 'purchase') up
  from {events} e),
met as (
  select * from sent join segments on event_no = segment),
named as (
  select event_id seq, ts_us, capture, up, len, payload,
         k % 4 svc, case when k % 4 in (0, 3) then 6 else 17 end proto,
         concat('10.', user_id div 65536, '.', user_id div 256 % 256, '.', user_id % 256) cip,
         cast(40000 + user_id % 25000 as int) cport,
         concat('192.168.0.', k % 4) sip,
         case when k % 4 < 2 then 443 else 53 end sport
  from met)
select capture, seq, ts_us, ts_us / 1000000.0D t, svc, concat('svc', svc) label, proto,
       if(up, cip, sip) src_ip, if(up, cport, sport) src_port,
       if(up, sip, cip) dst_ip, if(up, sport, cport) dst_port,
       len, payload
from named
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(rows: DataFrame, ident: str, number: str) -> tuple[DataFrame, int]:
    """The rows with ``number``, the 0-based rank of their id, and how many there are.

    Ids that already run from 0 without gaps are their ranks.
    """
    n, ids, low, high = rows.agg(
        F.count(F.lit(1)), F.count_distinct(ident), F.min(ident), F.max(ident)).first()
    if n == ids and (n == 0 or (low, high) == (0, n - 1)):
        return rows.withColumn(number, F.col(ident).cast("bigint")), n
    order = [F.col(ident), F.xxhash64(*rows.columns)]
    return with_rank(rows, [], order, F.coalesce(F.shiftright(F.col(ident), 10), F.lit(-(1 << 62))), rank=number, once=True), n


def packets(spark: SparkSession, sf_dir: str, nbytes: int | None = None) -> DataFrame:
    """Decoded packets: capture, seq, ts_us, t, svc, label, proto, endpoints, len, payload.

    With ``nbytes`` the payload is cut to its first bytes, ``len`` is still that of the whole. Lengths and cuts are
    taken before documents and events meet, so no more of the payload moves than is asked for.
    Documents and events meet by the ranks of their ids. With more documents than events, a packet
    carries the texts of several.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events, n_events = _numbered(table(spark, sf_dir, "events"), "event_id", "event_no")
    text = F.coalesce("text", F.lit("")).alias("text")
    texts, n_docs = _numbered(table(spark, sf_dir, "documents").select("doc_id", text), "doc_id", "slot")
    n_slots = max(1, min(n_docs, n_events))
    if n_docs > n_events:
        listed = F.sort_array(F.collect_list(F.struct("slot", "text")))
        texts = texts.groupBy(F.pmod("slot", F.lit(n_slots)).alias("at")).agg(
            F.concat_ws("", F.transform(listed, lambda x: x["text"])).alias("text")).withColumnRenamed("at", "slot")
    texts = texts.select("slot", "text", F.lit(n_slots).alias("n_slots"), F.lit(n_events).alias("n_events"))
    payload = "piece.payload" if nbytes is None else f"substring(piece.payload, 1, {nbytes})"
    return spark.sql(PACKETS_SQL.format(events="{events}", texts="{texts}", payload=payload), events=events, texts=texts)


def _ip_hex(ip):
    parts = F.split(ip, r"\.")
    return F.concat(*[hex_fixed(parts[i].cast("int"), 2) for i in range(4)])


def frames(pk: DataFrame) -> DataFrame:
    """Captured frames for a packet table: one link type per capture.

    Capture 0 is Ethernet (1), 1 is raw IP (101), the rest Linux cooked (113).
    """
    transport = F.when(F.col("proto") == 6, 20).otherwise(8)
    ip = F.concat(
        F.lit("4500"), hex_fixed(20 + transport + F.col("len"), 4), F.lit("0000000040"),
        hex_fixed(F.col("proto"), 2), F.lit("0000"),
        _ip_hex(F.col("src_ip")), _ip_hex(F.col("dst_ip")),
    )
    ports = F.concat(hex_fixed(F.col("src_port"), 4), hex_fixed(F.col("dst_port"), 4))
    l4 = F.when(
        F.col("proto") == 6, F.concat(ports, F.lit("0000000000000000" "5018ffff00000000"))
    ).otherwise(F.concat(ports, hex_fixed(8 + F.col("len"), 4), F.lit("0000")))
    linktype = F.when(F.col("capture") == 0, 1).when(F.col("capture") == 1, 101).otherwise(113)
    link = (
        F.when(linktype == 1, "000000000001000000000002" "0800")
        .when(linktype == 113, "0000" "0001" "0006" "0000000000020000" "0800")
        .otherwise("")
    )
    frame = F.concat(F.unhex(F.concat(link, ip, l4)), F.col("payload"))
    return pk.select(
        "capture", "seq", "ts_us", linktype.alias("linktype"),
        F.octet_length(frame).alias("origlen"), frame.alias("frame"),
    )
