"""Flow assembly, per-flow sequences and corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.functions.arrays import joined
from flowmill.operators import encode as en
from flowmill.operators import flows as fl
from flowmill.plans.oracle import define
from flowmill.plans.packet_plans import assembled, kept, tokens
from flowmill.plans.registry import query
from flowmill.session import shared_folder
from flowmill.sources import corpus

define("sequences", """
  select flow_key, min(capture) capture, min(label) as label, min(proto) proto,
         string_agg(cast(size_token as varchar), ' ' order by rank) sizes,
         string_agg(cast(iat_token as varchar), ' ' order by rank) iats,
         string_agg(concat(direction, ' ', trim(regexp_replace(head_hex, '(..)', '\\1 ', 'g'))), chr(10)
                    order by rank) filter (rank < 8) packets
  from tokens group by flow_key
""", "tokens")


def sequences(spark, sf_dir, max_packets=256):
    return fl.flow_sequences(tokens(spark, sf_dir, max_packets=max_packets), max_packets)


@query("assemble_flows", """
  select seq, flow_key, cli_ip, cli_port, srv_ip, srv_port, direction, n_packets, n_payload
  from assembled
""", "assembled")
def assemble_flows(spark, sf_dir):
    return assembled(spark, sf_dir).select(
        "seq", "flow_key", "cli_ip", "cli_port", "srv_ip", "srv_port", "direction",
        "n_packets", "n_payload",
    )


@query("flow_payload_count", "select flow_key, file_name, n_packets, n_payload from flow_list", "flow_list")
def flow_payload_count(spark, sf_dir):
    return fl.flow_table(kept(spark, sf_dir)).select("flow_key", "file_name", "n_packets", "n_payload")


@query("flow_sequences", """
  select flow_key, label, proto, packets, sizes as size_tokens, iats as iat_tokens from sequences
""", "sequences")
def flow_sequences(spark, sf_dir):
    lines = F.transform(
        "packets", lambda p: F.concat_ws(" ", p["direction"].cast("string"), F.array_join(p["tokens"], " "))
    )
    return sequences(spark, sf_dir).select(
        "flow_key", "label", "proto", F.array_join(lines, "\n").alias("packets"),
        joined(F.col("size_tokens")).alias("size_tokens"),
        joined(F.col("iat_tokens")).alias("iat_tokens"),
    )


@query("files_per_label", """
  select label, count(distinct (capture, file_name)) files from flow_list where n_payload >= 5 group by label
""", "flow_list")
def files_per_label(spark, sf_dir):
    flows = fl.flow_table(kept(spark, sf_dir)).filter(F.col("n_payload") >= fl.MIN_PAYLOAD_PACKETS)
    return fl.files_per_label(flows)


@query("split_report", """
  select capture, cast(count(*) as bigint) flows_found,
         cast(count(*) filter (n_payload >= 5) as bigint) flows_valid
  from flow_list group by capture
""", "flow_list")
def split_report(spark, sf_dir):
    return fl.split_report(kept(spark, sf_dir))


@query("flow_initiator", """
  select flow_key, cli_ip, cli_port from flow_list
""", "flow_list")
def flow_initiator(spark, sf_dir):
    return fl.flow_table(kept(spark, sf_dir)).select("flow_key", "cli_ip", "cli_port")


@query("inter_arrival", "select seq, round(gap, 6) gap from paid", "paid")
def inter_arrival(spark, sf_dir):
    return fl.payload_packets(assembled(spark, sf_dir)).select("seq", F.round("gap", 6).alias("gap"))


@query("iat_token", "select seq, iat_token from tokens", "tokens")
def iat_token(spark, sf_dir):
    return tokens(spark, sf_dir).select("seq", "iat_token")


@query("packet_rank", "select seq, flow_key, cast(rank as bigint) as rank from paid", "paid")
def packet_rank(spark, sf_dir):
    return fl.payload_packets(assembled(spark, sf_dir)).select("seq", "flow_key", "rank")


@query("token_position", """
  select flow_key, cast(rank as int) packet, cast(pos - 1 as int) as position,
         cast(('0x' || hex)::int + 5 as int) token
  from (select flow_key, rank, row_number() over (partition by flow_key order by rank, k) pos,
               substr(head_hex, cast(2 * k - 1 as bigint), 2) hex
        from (select flow_key, rank, head_hex, unnest(range(1, 1 + length(head_hex) // 2)) k
              from tokens where rank < 8))
  where pos <= 510
""", "tokens")
def token_position(spark, sf_dir):
    return en.token_positions(sequences(spark, sf_dir, 8)).select("flow_key", "packet", "position", "token")


define("raw_text", """
  select concat(proto, chr(10), packets, chr(10)) as value, * from sequences
""", "sequences")
define("size_text", """
  select concat(proto, chr(10), sizes, chr(10), iats, chr(10)) as value, * from sequences
""", "sequences")


def stored_raw(spark, sf_dir):
    path = shared_folder(spark, "raw-corpus")
    corpus.write_raw_corpus(sequences(spark, sf_dir, 8), path)
    return path


def stored_size(spark, sf_dir):
    path = shared_folder(spark, "size-corpus")
    # Four packets per row, so that lines are put together from several pieces.
    chunks = fl.size_chunks(tokens(spark, sf_dir), per_chunk=4)
    corpus.write_size_corpus(chunks, path, files=8)
    return path


def records(spark, path):
    text = spark.read.option("lineSep", "||\n").text(path)
    return text.filter(F.col("value") != "")


@query("write_raw_corpus", "select value from raw_text", "raw_text")
def write_raw_corpus(spark, sf_dir):
    return records(spark, stored_raw(spark, sf_dir))


@query("write_size_corpus", "select value from size_text", "size_text")
def write_size_corpus(spark, sf_dir):
    return records(spark, stored_size(spark, sf_dir))


@query("read_raw_corpus", """
  select case when proto = 6 then 0 else 1 end protocol, packets from sequences
""", "sequences")
def read_raw_corpus(spark, sf_dir):
    lines = F.transform(
        "packets", lambda p: F.concat_ws(" ", p["direction"].cast("string"), F.array_join(p["tokens"], " "))
    )
    return corpus.read_raw_corpus(spark, stored_raw(spark, sf_dir)).select(
        "protocol", F.array_join(lines, "\n").alias("packets")
    )


@query("read_size_corpus", """
  select case when proto = 6 then 0 else 1 end protocol, sizes as size_tokens, iats as iat_tokens
  from sequences
""", "sequences")
def read_size_corpus(spark, sf_dir):
    return corpus.read_size_corpus(spark, stored_size(spark, sf_dir)).select(
        "protocol", joined(F.col("size_tokens")).alias("size_tokens"),
        joined(F.col("iat_tokens")).alias("iat_tokens"),
    )


@query("corpus_counts", """
  select 'raw' corpus, cast(count(*) as bigint) flows,
         cast(sum(2 + length(packets) - length(replace(packets, chr(10), '')) + 1) as bigint) as lines
  from sequences
  union all
  select 'size', cast(count(*) as bigint), cast(4 * count(*) as bigint) from sequences
""", "sequences")
def corpus_counts(spark, sf_dir):
    raw = corpus.corpus_counts(spark, stored_raw(spark, sf_dir)).withColumn("corpus", F.lit("raw"))
    size = corpus.corpus_counts(spark, stored_size(spark, sf_dir)).withColumn("corpus", F.lit("size"))
    return raw.unionByName(size)
