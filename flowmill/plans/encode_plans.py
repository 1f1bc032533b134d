"""Encoded instances, masking, entropy, shards and batches."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowmill.functions.arrays import joined
from flowmill.functions.ranking import with_rank
from flowmill.functions.rng import uniform
from flowmill.operators import batches as ba
from flowmill.operators import encode as en
from flowmill.operators import entropy
from flowmill.operators import evaluate as ev
from flowmill.operators import masking as ma
from flowmill.operators import model, pairing
from flowmill.plans.flow_plans import sequences
from flowmill.plans.oracle import define
from flowmill.plans.registry import query
from flowmill.session import save_and_reload, shared_folder
from flowmill.sources import tables

SEED = 7


def u_sql(*parts: str) -> str:
    """SQL of a uniform draw over '|'-joined parts."""
    text = ", ".join(parts)
    return f"(('0x' || substr(md5(concat_ws('|', {text})), 1, 8))::ubigint / 4294967296e0)"


define("raw_tokens", """
  select flow_key, cast(rank as int) packet, direction, pos, cast(('0x' || hex)::int + 5 as int) token
  from (select flow_key, rank, direction, row_number() over (partition by flow_key order by rank, k) pos,
               substr(head_hex, cast(2 * k - 1 as bigint), 2) hex
        from (select flow_key, rank, direction, head_hex, unnest(range(1, 1 + length(head_hex) // 2)) k
              from tokens where rank < 8))
  where pos <= 510
""", "tokens")
define("raw_seq", """
  select flow_key, list_resize([2] || list(token order by pos) || [3], 512, 0) src,
         list_resize([8] || list(packet order by pos) || [8], 512, 8) packet_ids,
         list_resize([1] || list(if(direction = -1, 0, 2) order by pos) || [1], 512, 1) directions
  from raw_tokens group by flow_key
""", "raw_tokens")
define("size_seq", """
  select flow_key, list_resize([2] || list(size_token + 5 order by rank) || [3], 256, 0) src_size,
         list_resize([2] || list(iat_token + 5 order by rank) || [3], 256, 0) src_iat
  from tokens where rank < 254 group by flow_key
""", "tokens")


def encoded(spark, sf_dir):
    return en.paired_instance(sequences(spark, sf_dir))


def size_rows(spark, sf_dir):
    return en.encode_size_iat(sequences(spark, sf_dir)).select("flow_key", "label", "src_size", "src_iat")


@query("encode_raw", """
  select flow_key, array_to_string(src, ' ') src, array_to_string(packet_ids, ' ') packet_ids,
         array_to_string(directions, ' ') directions
  from raw_seq
""", "raw_seq")
def encode_raw(spark, sf_dir):
    return en.encode_raw(sequences(spark, sf_dir, 8)).select(
        "flow_key", *[joined(F.col(c)).alias(c) for c in ("src", "packet_ids", "directions")]
    )


@query("encode_size_iat", """
  select flow_key, array_to_string(src_size, ' ') src_size, array_to_string(src_iat, ' ') src_iat
  from size_seq
""", "size_seq")
def encode_size_iat(spark, sf_dir):
    return size_rows(spark, sf_dir).select(
        "flow_key", joined(F.col("src_size")).alias("src_size"), joined(F.col("src_iat")).alias("src_iat")
    )


PAIRED = ("src", "packet_ids", "directions", "src_size", "src_iat")
PAIRED_SQL = ", ".join(f"array_to_string({c}, ' ') {c}" for c in PAIRED)


@query("paired_instance", f"select flow_key, {PAIRED_SQL} from raw_seq join size_seq using (flow_key)",
       "raw_seq", "size_seq")
def paired_instance(spark, sf_dir):
    return encoded(spark, sf_dir).select("flow_key", *[joined(F.col(c)).alias(c) for c in PAIRED])


def _shares_sql(column: str, bins: int, per_bin: int) -> str:
    """SQL of the share of tokens in each of ``bins`` ranges of ids from 5 on, to 9 digits."""
    kept = f"list_filter({column}, lambda x: x >= 5)"
    return (
        f"list_transform(range(0, {bins}), lambda b: round(len(list_filter({kept},"
        f" lambda x: x >= 5 + b * {per_bin} and x < 5 + (b + 1) * {per_bin})) / greatest(len({kept}), 1)::double, 9))"
    )


@query("baseline_features", f"""
  select flow_key, array_to_string({_shares_sql("src", 16, 16)} || {_shares_sql("src_size", 30, 101)}
                                   || {_shares_sql("src_iat", 20, 50)}, ' ') as features
  from raw_seq join size_seq using (flow_key)
""", "raw_seq", "size_seq")
def baseline_features(spark, sf_dir):
    """The histograms that the baseline classifier is fitted on."""
    rows = model.features(encoded(spark, sf_dir)).select("flow_key", vector_to_array("features").alias("v"))
    shares = F.transform("v", lambda x: F.round(x, 9))
    return rows.select("flow_key", F.array_join(shares.cast("array<string>"), " ").alias("features"))


@query("write_instances", f"select flow_key, {PAIRED_SQL} from raw_seq join size_seq using (flow_key)",
       "raw_seq", "size_seq")
def write_instances(spark, sf_dir):
    path = shared_folder(spark, "instances")
    tables.write_instances(encoded(spark, sf_dir).select("flow_key", *PAIRED), path)
    return tables.read_instances(spark, path).select(
        "flow_key", *[joined(F.col(c)).alias(c) for c in PAIRED]
    )


@query("read_instances", """
  select label, cast(count(*) as bigint) as rows, cast(sum(list_sum(src)) as bigint) total
  from raw_seq join size_seq using (flow_key) join flow_list using (flow_key) group by label
""", "raw_seq", "size_seq", "flow_list")
def read_instances(spark, sf_dir):
    # Two parts written apart and read as one.
    rows = encoded(spark, sf_dir).select("flow_key", "label", *PAIRED)
    paths = [shared_folder(spark, "instances") for _ in range(2)]
    tables.write_instances(rows.filter(F.col("label") == "svc0"), paths[0])
    tables.write_instances(rows.filter(F.col("label") != "svc0"), paths[1])
    total = F.aggregate("src", F.lit(0), lambda s, x: s + x)
    return tables.read_instances(spark, *paths).groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(total).alias("total")
    )


# Masking equivalents work on one row per position instead of arrays.
define("dups", "select unnest(range(0, 5)) dup")
define("size_pos", """
  select flow_key, dup, pos, src_size[pos + 1] size_id, src_iat[pos + 1] iat_id,
         length(list_filter(src_size, lambda x: x <> 0)) used
  from (select *, unnest(range(0, 256)) pos from size_seq), dups
  where src_size[pos + 1] not in (0, 2, 3)
""", "size_seq", "dups")
define("size_plan", """
  select * from (
    select *, row_number() over (partition by flow_key, dup
             order by md5(concat_ws('|', 7, 'mask', flow_key, dup, pos))) pick
    from size_pos)
  where pick <= greatest(1, round_even(used * 0.15e0, 0))
""", "size_pos")


def replaced_sql(token: str, salt: str, vocab: int, ident: str = "flow_key, dup", at: str = "pos") -> str:
    draw = u_sql("7", f"'{salt}draw'", ident, at)
    r = f"cast(floor({u_sql('7', chr(39) + salt + 'token' + chr(39), ident, 'pos')} * {vocab - 4}) as int)"
    return (
        f"case when {draw} < 0.8e0 then 4 when {draw} < 0.9e0 then "
        f"if({r} = 0, 1, {r} + 4) else {token} end"
    )


define("size_masked", f"""
  select flow_key, dup, pos, size_id, iat_id, {replaced_sql('size_id', '', 3006)} new_size,
         {replaced_sql('iat_id', 'iat-', 1005)} new_iat
  from size_plan
""", "size_plan")


def dup_rows(spark, sf_dir):
    return en.duplicate_instances(size_rows(spark, sf_dir))


@query("duplicate_instances", """
  select flow_key, cast(dup as int) dup, array_to_string(src_size, ' ') src_size from size_seq, dups
""", "size_seq", "dups")
def duplicate_instances(spark, sf_dir):
    return dup_rows(spark, sf_dir).select("flow_key", "dup", joined(F.col("src_size")).alias("src_size"))


@query("mask_plan", "select flow_key, cast(dup as int) dup, cast(pos as int) as position from size_plan", "size_plan")
def mask_plan(spark, sf_dir):
    plan = ma.picked_positions(F.col("src_size"), SEED, [F.col("flow_key"), F.col("dup")])
    return dup_rows(spark, sf_dir).select("flow_key", "dup", F.explode_outer(plan).alias("position"))


define("raw_plan", """
  select * from (
    select *, row_number() over (partition by flow_key order by md5(concat_ws('|', 7, 'mask', flow_key, 0, pos))) pick
    from (select flow_key, 0 dup, cast(pos as int) pos, token, count(*) over (partition by flow_key) + 2 used
          from raw_tokens))
  where pick <= greatest(1, round_even(used * 0.15e0, 0))
""", "raw_tokens")


@query("mask_tokens", f"""
  select flow_key, pos as position, token, cast({replaced_sql('token', '', 261)} as int) masked from raw_plan
""", "raw_plan")
def mask_tokens(spark, sf_dir):
    rows = en.encode_raw(sequences(spark, sf_dir, 8)).withColumn("dup", F.lit(0))
    return (
        ma.mask_raw(rows, SEED)
        .select("flow_key", "src_masked", F.explode_outer("tgt").alias("t"))
        .select(
            "flow_key", F.col("t.pos").alias("position"), F.col("t.token").alias("token"),
            F.get("src_masked", F.col("t.pos")).alias("masked"),
        )
    )


CUMULATIVE = ", ".join(f"{c!r}e0" for c in ma._span_cumulative(0.2, 10))


def span_length_sql(u: str) -> str:
    return f"1 + length(list_filter([{CUMULATIVE}], lambda c: {u} >= c))"


# Spans of a byte sequence: its tokens are positions 1..n, between [CLS] and [SEP].
define("span_base", """
  select flow_key, src, length(list_filter(src, lambda x: x <> 0)) as used from raw_seq
""", "raw_seq")
define("span_walk", f"""
  select flow_key, used, cast(1 as bigint) as pos,
         cast({span_length_sql(u_sql('7', "'span'", 'flow_key', '0', '1'))} as bigint) as len
  from span_base
  union all
  select flow_key, used, later, cast({span_length_sql('u')} as bigint)
  from (select flow_key, used, pos + len as later, {u_sql('7', "'span'", 'flow_key', '0', 'pos + len')} u
        from span_walk where pos + len <= used - 2)
""", "span_base")
define("spans", """
  select flow_key, used, pos, least(len, used - pos) as len,
         row_number() over (partition by flow_key order by md5(concat_ws('|', 7, 'mask', flow_key, 0, pos))) k
  from span_walk
""", "span_walk")
define("span_pick", """
  select flow_key, cast(0 as bigint) k, cast(0 as bigint) total, cast(null as bigint) as pos, cast(0 as bigint) as len
  from span_base
  union all
  select s.flow_key, s.k, if(fits, p.total + s.len, p.total), if(fits, s.pos, null), s.len
  from span_pick p
  join (select *, greatest(1, round_even(used * 0.15e0, 0)) as most from spans) s
    on s.flow_key = p.flow_key and s.k = p.k + 1,
  lateral (select p.total + s.len <= s.most fits)
""", "spans", "span_base")


@query("mask_spans", f"""
  select flow_key, cast(pos as int) as position, token, cast({replaced_sql('token', '', 261, 'flow_key, 0', 'span')} as int) masked
  from (select p.flow_key, p.span, p.span + i as pos, b.src[cast(p.span + i + 1 as int)] as token
        from (select flow_key, pos as span, unnest(range(0, len)) i from span_pick where pos is not null) p
        join span_base b using (flow_key))
""", "span_pick", "span_base")
def mask_spans(spark, sf_dir):
    rows = en.encode_raw(sequences(spark, sf_dir, 8)).withColumn("dup", F.lit(0))
    return (
        ma.mask_raw(rows, SEED, spans=True)
        .select("flow_key", "src_masked", F.explode_outer("tgt").alias("t"))
        .select(
            "flow_key", F.col("t.pos").alias("position"), F.col("t.token").alias("token"),
            F.get("src_masked", F.col("t.pos")).alias("masked"),
        )
    )


@query("span_length", f"""
  select seq, cast({span_length_sql('u')} as int) span_length
  from (select seq, {u_sql('7', "'span'", 'seq')} u from packets)
""", "packets")
def span_length(spark, sf_dir):
    from flowmill import fixtures as fx

    return fx.packets(spark, sf_dir).select(
        "seq", ma.span_length(uniform(SEED, "span", F.col("seq"))).alias("span_length")
    )


@query("mask_synchronized", """
  select flow_key, cast(dup as int) dup, cast(pos as int) as position, size_id as size_token, iat_id as iat_token,
         cast(new_size as int) size_masked, cast(new_iat as int) iat_masked
  from size_masked
""", "size_masked")
def mask_synchronized(spark, sf_dir):
    masked = ma.static_masking(dup_rows(spark, sf_dir), SEED)
    return (
        masked.select("flow_key", "dup", "size_masked", "iat_masked",
                      F.inline_outer(F.arrays_zip("tgt_size", "tgt_iat")))
        .select(
            "flow_key", "dup", F.col("tgt_size.pos").alias("position"),
            F.col("tgt_size.token").alias("size_token"), F.col("tgt_iat.token").alias("iat_token"),
            F.get("size_masked", F.col("tgt_size.pos")).alias("size_masked"),
            F.get("iat_masked", F.col("tgt_size.pos")).alias("iat_masked"),
        )
    )


define("static_rows", """
  select s.flow_key, dup,
         list_transform(range(0, 256), lambda i: coalesce(map_extract_value(m.sizes, i), s.src_size[i + 1])) size_masked,
         list_transform(range(0, 256), lambda i: coalesce(map_extract_value(m.iats, i), s.src_iat[i + 1])) iat_masked,
         list_transform(range(0, 256), lambda i: coalesce(map_extract_value(m.tgt_sizes, i), 0)) tgt_size,
         list_transform(range(0, 256), lambda i: coalesce(map_extract_value(m.tgt_iats, i), 0)) tgt_iat
  from size_seq s join (
    select flow_key, dup, map(list(pos), list(new_size)) sizes, map(list(pos), list(new_iat)) iats,
           map(list(pos), list(size_id)) tgt_sizes, map(list(pos), list(iat_id)) tgt_iats
    from size_masked group by flow_key, dup) m using (flow_key)
""", "size_seq", "size_masked")


@query("static_masking", """
  select flow_key, cast(dup as int) dup, array_to_string(size_masked, ' ') size_masked,
         array_to_string(iat_masked, ' ') iat_masked
  from static_rows
""", "static_rows")
def static_masking(spark, sf_dir):
    return ma.static_masking(dup_rows(spark, sf_dir), SEED).select(
        "flow_key", "dup", joined(F.col("size_masked")).alias("size_masked"),
        joined(F.col("iat_masked")).alias("iat_masked"),
    )


@query("dense_targets", """
  select flow_key, cast(dup as int) dup, array_to_string(tgt_size, ' ') tgt_size from static_rows
""", "static_rows")
def dense_targets(spark, sf_dir):
    masked = ma.static_masking(dup_rows(spark, sf_dir), SEED)
    return masked.select(
        "flow_key", "dup", joined(ma.dense_targets(F.col("tgt_size"), 256)).alias("tgt_size")
    )


define("epochs", "select unnest(range(0, 2)) epoch")
define("epoch_pos", """
  select flow_key, 'epoch' || epoch dup, pos, src_size[pos + 1] size_id, src_iat[pos + 1] iat_id,
         length(list_filter(src_size, lambda x: x <> 0)) used
  from (select *, unnest(range(0, 256)) pos from size_seq), epochs
  where src_size[pos + 1] not in (0, 2, 3)
""", "size_seq", "epochs")
define("epoch_plan", """
  select * from (
    select *, row_number() over (partition by flow_key, dup
             order by md5(concat_ws('|', 7, 'mask', flow_key, dup, pos))) pick
    from epoch_pos)
  where pick <= greatest(1, round_even(used * 0.15e0, 0))
""", "epoch_pos")


@query("dynamic_masking", f"""
  select flow_key, cast(substr(dup, 6) as int) epoch, cast(pos as int) as position,
         cast({replaced_sql('size_id', '', 3006)} as int) size_masked,
         cast({replaced_sql('iat_id', 'iat-', 1005)} as int) iat_masked
  from epoch_plan
""", "epoch_plan")
def dynamic_masking(spark, sf_dir):
    rows = size_rows(spark, sf_dir)
    epochs = [
        ma.dynamic_masking(rows, e, SEED).withColumn("epoch", F.lit(e)) for e in range(2)
    ]
    return (
        epochs[0].unionByName(epochs[1])
        .select("flow_key", "epoch", "size_masked", "iat_masked", F.explode_outer("tgt_size").alias("t"))
        .select(
            "flow_key", "epoch", F.col("t.pos").alias("position"),
            F.get("size_masked", F.col("t.pos")).alias("size_masked"),
            F.get("iat_masked", F.col("t.pos")).alias("iat_masked"),
        )
    )


NINE_SQL = ", ".join(f"array_to_string({c}, ' ') {c}" for c in ma.CLEAN_AND_MASKED)


@query("clean_and_masked", f"""
  select flow_key, cast(dup as int) dup, {NINE_SQL}
  from raw_seq join size_seq using (flow_key) join static_rows using (flow_key)
""", "raw_seq", "size_seq", "static_rows")
def clean_and_masked(spark, sf_dir):
    # What the variants of a flow share is written out once, before there are five of it.
    texts = {c: f"{c}_text" for c in PAIRED}
    once = encoded(spark, sf_dir).select("flow_key", *PAIRED, *[joined(F.col(c)).alias(t) for c, t in texts.items()])
    rows = en.duplicate_instances(once)
    full = ma.clean_and_masked(ma.static_masking(rows, SEED), also=tuple(texts.values()))
    return full.select("flow_key", "dup", *[
        F.col(texts[c]).alias(c) if c in texts else joined(F.col(c)).alias(c) for c in ma.CLEAN_AND_MASKED])


@query("flow_entropy_reliability", """
  select flow_key, round(case when ln(least(max(n), 261)) > 0 then
           greatest(0, least(1, 1 - sum(-(c / n) * ln(c / n + 1e-10)) / ln(least(max(n), 261))))
         else 1 end, 6) reliability
  from (select flow_key, token, count(*) c, sum(count(*)) over (partition by flow_key) n
        from (select flow_key, unnest(src) token from raw_seq) where token <> 0
        group by flow_key, token)
  group by flow_key
""", "raw_seq")
def flow_entropy_reliability(spark, sf_dir):
    rows = en.encode_raw(sequences(spark, sf_dir, 8))
    return rows.select(
        "flow_key", F.round(entropy.flow_reliability(F.col("src"), en.VOCAB_RAW), 6).alias("reliability")
    )


@query("local_entropy", """
  select flow_key, cast(pos as int) as position,
         case when token = 0 then 0e0 when n <= 1 then 1e0
              else round(greatest(0, least(1, 1 - (ln(n) - s / n) / ln(n))), 6) end reliability
  from (select *, length(w) n,
               list_sum(list_transform(w, lambda x: ln(length(list_filter(w, lambda y: y = x))))) s
        from (select flow_key, pos, src[pos + 1] token,
                     list_filter(src[greatest(1, pos - 7):least(512, pos + 9)], lambda x: x <> 0) w
              from (select flow_key, src, unnest(range(0, 512)) pos from raw_seq)))
""", "raw_seq")
def local_entropy(spark, sf_dir):
    rows = en.encode_raw(sequences(spark, sf_dir, 8))
    return rows.select(
        "flow_key", F.posexplode_outer(entropy.local_reliability(F.col("src"))).alias("position", "r")
    ).select("flow_key", "position", F.round("r", 6).alias("reliability"))


define("shuffled", """
  select flow_key, row_number() over (order by md5(concat_ws('|', 7, 'shuffle', 1, flow_key))) - 1 ordinal,
         count(*) over () total
  from size_seq
""", "size_seq")


@query("shuffle", "select flow_key, cast(ordinal as bigint) as ordinal from shuffled", "shuffled")
def shuffle(spark, sf_dir):
    return ba.shuffle(size_rows(spark, sf_dir), ["flow_key"], SEED, epoch=1).select("flow_key", "ordinal")


SHARDS, BATCH = 4, 32
define("sharded", """
  select *, cast((1 * total + ordinal) % 4 as int) shard from shuffled
""", "shuffled")
define("batched", """
  select *, cast((row_number() over (partition by shard order by ordinal) - 1) // 32 as bigint) batch_id
  from sharded
""", "sharded")


def batched(rows):
    return ba.batch_id(
        ba.round_robin_shard(ba.shuffle(rows, ["flow_key"], SEED, epoch=1), SHARDS, epoch=1),
        BATCH, SHARDS, epoch=1,
    )


@query("round_robin_shard", "select flow_key, shard from sharded", "sharded")
def round_robin_shard(spark, sf_dir):
    rows = ba.shuffle(size_rows(spark, sf_dir), ["flow_key"], SEED, epoch=1)
    return ba.round_robin_shard(rows, SHARDS, epoch=1).select("flow_key", "shard")


@query("batch_id", "select flow_key, shard, batch_id from batched", "batched")
def batch_id(spark, sf_dir):
    return batched(size_rows(spark, sf_dir)).select("flow_key", "shard", "batch_id")


@query("masked_token_count", """
  select shard, batch_id, cast(count(*) as bigint) masked
  from size_masked join batched using (flow_key) group by shard, batch_id
""", "size_masked", "batched")
def masked_token_count(spark, sf_dir):
    rows = batched(size_rows(spark, sf_dir))
    masked = ma.static_masking(en.duplicate_instances(rows), SEED)
    return ma.masked_token_count(masked.withColumn("b", F.struct("shard", "batch_id")), "b").select(
        "b.shard", "b.batch_id", "masked"
    )


@query("masked_accuracy", f"""
  select cast(count(*) as bigint) n, cast(count(*) filter (pred = iat_id) as bigint) exact,
         cast(count(*) filter (abs(pred - iat_id) <= 10) as bigint) within_sigma,
         round(count(*) filter (pred = iat_id) / (count(*) + 1e-6), 6) accuracy,
         round(count(*) filter (abs(pred - iat_id) <= 10) / (count(*) + 1e-6), 6) range_accuracy
  from (select *, iat_id + cast(floor({u_sql('7', "'guess'", 'flow_key, dup', 'pos')} * 41e0) as int) - 20 pred
        from size_masked)
""", "size_masked")
def masked_accuracy(spark, sf_dir):
    masked = ma.static_masking(dup_rows(spark, sf_dir), SEED)
    targets = masked.select("flow_key", "dup", F.inline_outer("tgt_iat")).withColumnRenamed("token", "target")
    # Stand-in predictions: the target moved by a uniform step in -20..20.
    guess = F.floor(uniform(SEED, "guess", F.col("flow_key"), F.col("dup"), F.col("pos")) * 41.0) - 20
    return ev.masked_accuracy(targets.withColumn("prediction", F.col("target") + guess.cast("int")))


@query("pair_modalities", """
  select flow_key, label, array_to_string(src, ' ') src, array_to_string(src_size, ' ') src_size
  from raw_seq join size_seq using (flow_key) join flow_list using (flow_key)
""", "raw_seq", "size_seq", "flow_list")
def pair_modalities(spark, sf_dir):
    rows = sequences(spark, sf_dir)
    raw = en.encode_raw(rows).select("flow_key", "label", "proto", "src")
    size = en.encode_size_iat(rows).select("flow_key", "proto", "src_size", "src_iat")
    return pairing.pair_modalities(raw, size).select(
        "flow_key", "label", joined(F.col("src")).alias("src"), joined(F.col("src_size")).alias("src_size")
    )


# Two corpora of one flow order that went apart: Windows line ends, padded separators, a protocol
# that differs in every seventh flow, no IATs in every fifth, and one side shorter.
define("two_corpora", """
  select (row_number() over (order by flow_key)) - 1 as record, * from sequences
""", "sequences")


def two_corpora(spark, sf_dir):
    rows = save_and_reload(sequences(spark, sf_dir), "sequences")
    rows = with_rank(rows, [], [F.col("flow_key")], F.substring("flow_key", 1, 8), rank="record", total="n")
    rows = save_and_reload(rows, "ordered").repartitionByRange(6, "record").sortWithinPartitions("record")
    number = F.col("record")
    packets = F.transform("packets", lambda p: F.concat_ws(" ", p["direction"].cast("string"), F.array_join(p["tokens"], " ")))
    raw = F.concat_ws("\n", F.lit("|| "), F.col("proto").cast("string"), F.array_join(packets, "\n"))
    other = F.when(number % 7 == 0, 23 - F.col("proto")).otherwise(F.col("proto"))
    iats = F.when(number % 5 == 0, F.lit("")).otherwise(joined(F.col("iat_tokens")))
    size = F.concat_ws("\r\n", F.lit("\t||"), other.cast("string"), joined(F.col("size_tokens")), iats)
    paths = shared_folder(spark, "raw-side"), shared_folder(spark, "size-side")
    rows.select(raw.alias("value")).write.text(paths[0])
    rows.filter(number < F.col("n") - 3).select(size.alias("value")).write.option("lineSep", "\r\n").text(paths[1])
    return paths


@query("pair_corpora", """
  select record, if(proto = 6, 0, 1) protocol, if(record % 7 = 0, 1 - if(proto = 6, 0, 1), if(proto = 6, 0, 1)) size_protocol,
         packets, sizes as size_tokens, iats as iat_tokens
  from two_corpora where record % 5 <> 0 and record < (select count(*) from two_corpora) - 3
""", "two_corpora")
def pair_corpora(spark, sf_dir):
    lines = F.transform("packets", lambda p: F.concat_ws(" ", p["direction"].cast("string"), F.array_join(p["tokens"], " ")))
    return pairing.pair_corpora(spark, *two_corpora(spark, sf_dir)).select(
        "record", "protocol", "size_protocol", F.array_join(lines, "\n").alias("packets"),
        joined(F.col("size_tokens")).alias("size_tokens"), joined(F.col("iat_tokens")).alias("iat_tokens"))


@query("pairing_audit", """
  select count(*) raw_flows, greatest(count(*) - 3, 0) size_flows, greatest(count(*) - 3, 0) pairs,
         count(*) filter (record % 7 = 0 and record < n - 3) protocol_mismatches,
         count(*) filter (record % 5 = 0 and record < n - 3) empty_iat
  from (select *, count(*) over () n from two_corpora)
""", "two_corpora")
def pairing_audit(spark, sf_dir):
    return pairing.pairing_audit(spark, *two_corpora(spark, sf_dir))
