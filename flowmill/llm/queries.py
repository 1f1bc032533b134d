"""The registered queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm import (
    fertility, filter_audit, licenses, mixing, ngram_jaccard, order_minhash, ordinal, packing, spelling, style_tree,
    tool_calls, url_filter, warc,
)
from flowmill.session import save_and_reload, shared_folder

#: Hosts with these are examples of what to reject.
SPAM_TERMS = ("pills", "bets", "casino", "viagra", "lottery", "xxx")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_tool_call_linking")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of all conversations, linked, ordered, validated and serialised."""
    calls, results = tool_calls.calls_of_conversations(_table(spark, sf_dir, "conversations"))
    linked = tool_calls.link_tool_calls(calls, results, tool_calls.SCHEMAS)
    return linked.withColumn("problems", F.array_join("problems", "; "))


@_query("op2_url_filters")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by host rules, else by the ratio of two character models."""
    return url_filter.judge_urls(
        _table(spark, sf_dir, "pages").select("page_id", "url"), seed_terms=SPAM_TERMS, folds=2)


@_query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the fertility bands of its language."""
    counts = save_and_reload(fertility.measured(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
        keep=["doc_id", "lang"]), "counts")
    return fertility.judged(counts).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "n_byte_tokens", *fertility.MEASURES)


@_query("op4_source_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix_sources(docs, weights=(5, 2, 1), share=1.5, most=2)
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@_query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document, fitted on the graded labels."""
    docs = _table(spark, sf_dir, "documents")
    model = ordinal.fit_grades(docs, ordinal.label_grades(_table(spark, sf_dir, "labels")), n_grades=3, accept_grade=2)
    graded = ordinal.grade_documents(docs.select("doc_id", "text"), model, accept_grade=2)
    return graded.select(
        "doc_id", "expected_grade", "tail_probability", F.col("accepted").alias("kept"))


@_query("op6_warc_bundles", """
with sized as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
firsts as (select payload_digest, min(page_id) as first from sized where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, if(page_id <> first, 'revisit', 'response') as record_type,
       case when page_id <> first then first end as refers_to
from sized left join firsts using (payload_digest)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from the archives written of all pages."""
    path = shared_folder(spark, "bundles")
    warc.write_bundles(_table(spark, sf_dir, "pages"), path)
    return warc.read_bundles(spark, path).select(
        F.expr("try_cast(record_id as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"))


@_query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, taken as a file of a directory tree."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return licenses.scan_licences(licenses.document_paths(docs), keep=("doc_id",))


@_query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


@_query("op9_order_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likeness to the latter and to the next document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    near = order_minhash.with_neighbours(docs)
    return near.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        order_minhash.fingerprint_text(F.col("entries")).alias("fingerprint"),
        order_minhash.fingerprint_text(F.col("edited_entries")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        order_minhash.likeness(F.col("entries"), F.col("next_entries")).alias("near_next"))


@_query("op10_ngram_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_jaccard.shingle_components(docs, width=3, percent=90)


@_query("op11_filter_audit", """
with word_lists as (
  select doc_id, coalesce(lang, '') as part, coalesce("text", '') as t,
         regexp_extract_all(coalesce("text", ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
flags as (
  select doc_id, part,
         (len(words) < 100)::int
         + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
         + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::int
         + 8 * regexp_matches(t, '[#$%&*|]')::int
         + 16 * coalesce(min(doc_id) over (partition by t) < doc_id, false)::int as mask
  from word_lists),
marks as (select doc_id, coalesce(max((quality = 1)::int), 0) as good, coalesce(max((toxic = 1)::int), 0) as toxic
          from labels group by doc_id),
cells as (
  select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from flags left join marks using (doc_id) group by part, mask),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as b),
orders as (
  select p.f || q.f || r.f || s.f || t.f as filter_order, [p.b, q.b, r.b, s.b, t.b] as bits
  from letters p, letters q, letters r, letters s, letters t
  where p.b + q.b + r.b + s.b + t.b = 31 and p.b | q.b | r.b | s.b | t.b = 31),
steps as (
  select filter_order, step, bits[step] as b,
         list_sum(bits[1:step])::int as upto from orders, (select unnest([1, 2, 3, 4, 5]) as step)),
walked as (
  select part, filter_order, step, b,
         sum(case when mask & upto = 0 then n else 0 end) as kept,
         sum(case when mask & upto = b then n else 0 end) as removed,
         sum(case when mask & b > 0 and mask & upto <> b then n else 0 end) as redundant,
         sum(case when mask = b then n else 0 end) as unique_fails,
         sum(case when mask & upto = b then good else 0 end) as good_lost,
         sum(case when mask & upto = b then toxic else 0 end) as toxic_lost
  from cells, steps group by part, filter_order, step, b)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed,
       redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
       toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, b))::bigint as shapley
from walked
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, by language."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return filter_audit.interaction_audit(filter_audit.failure_cells(docs, _table(spark, sf_dir, "labels")))


@_query("op12_style_tree")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, after the style trees of all hosts."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return style_tree.extract_pages(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@_query("op13_spelling_variants", """
with recursive crc(byte, value, bit) as (
  select b::bigint, b::bigint, 0 from range(256) r(b)
  union all
  select byte, case when value % 2 = 1 then xor(value // 2, 3988292384) else value // 2 end, bit + 1 from crc where bit < 8),
crc_table as (select list(value order by byte) as items from crc where bit = 8),
runs as (
  select doc_id, translate(unnest(regexp_extract_all("text", '[A-Za-z\\x{00C0}-\\x{00FF}]{6,}')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
grouped as (select doc_id, run, count(*) as n from runs group by doc_id, run),
digests as (
  select run, n, xor(4294967295::bigint, list_reduce(
           list_prepend(4294967295::bigint, list_transform(
             string_split(regexp_replace(hex(encode(coalesce(doc_id::varchar, '') || ':' || run)), '(..)', '\\1,', 'g'), ',')[:-2],
             lambda x: ('0x' || x)::bigint)),
           lambda a, x: xor(a >> 8, items[(xor(a, x) & 255) + 1]))) as h
  from grouped, crc_table),
noisy as (
  select case when h % 199 = 0 then run[1 : h % length(run)] || run[h % length(run) + 2 :] else run end as word, n
  from digests),
words as (
  select word, sum(n)::bigint as n from noisy where length(word) >= 6 group by word having sum(n) >= 5),
cuts as (
  select word, n, pos, word[1 : pos] || word[pos + 2 :] as rest
  from (select word, n, unnest(range(length(word))) as pos from words)),
pairs as (
  select x.word as a, y.word as b, y.n as n_b from cuts x join cuts y using (pos, rest)
  where x.word <> y.word and length(x.word) = length(y.word)
  union select x.word, y.word, y.n from cuts x join words y on x.rest = y.word
  union select y.word, x.word, x.n from cuts x join words y on x.rest = y.word),
best as (select a, count(*) as n_near, max(n_b) as top from pairs group by a),
tops as (select pairs.a, min(b) as b, any_value(top) as top, any_value(n_near) as n_near
         from pairs join best on pairs.a = best.a and n_b = top group by pairs.a),
formed as (
  select word, n, coalesce(n_near, 0) as n_near, case when top >= 5 * n then b end as form,
         case when top >= 5 * n then top end as form_n
  from words left join tops on word = a),
chain(word, last) as (
  select word, word from formed
  union all select chain.word, formed.form from chain join formed on chain.last = formed.word where form is not null)
select formed.word, form, chain.last as root, n, n_near::bigint as n_near, form_n
from formed join chain on formed.word = chain.word
where not exists (select 1 from formed x where x.word = chain.last and x.form is not null)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, typos planted, each with its near words and the form it is a variant of."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.spelling_groups(spelling.corpus_words(docs))
