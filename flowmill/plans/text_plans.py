"""Tokenization and vocabularies over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill import fixtures as fx
from flowmill.functions.arrays import joined
from flowmill.functions.ranking import with_rank
from flowmill.operators import text as tx
from flowmill.plans.flow_plans import sequences
from flowmill.plans.oracle import define
from flowmill.plans.registry import query
from flowmill.session import save_and_reload, shared_folder
from flowmill.sources import tables
from flowmill.sources.lines import numbered_lines

PUNCT = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\p{P}]"
CJK = (
    r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
    r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"
)
define("cleaned", r"""
  select doc_id, source, regexp_replace(regexp_replace(text, '[\t\n\r\p{Zs}]', ' ', 'g'),
                                        '[\p{Cc}\p{Cf}\x{FFFD}]', '', 'g') as body
  from documents
""")
define("spaced", f"""
  select doc_id, source, regexp_replace(body, '({CJK})', ' \\1 ', 'g') as body from cleaned
""", "cleaned")
define("doc_tokens", f"""
  select doc_id, source, unnest(toks) as token, generate_subscripts(toks, 1) - 1 as pos
  from (select doc_id, source, list_filter(string_split_regex(
                 regexp_replace(strip_accents(lower(body)), '({PUNCT})', ' \\1 ', 'g'), '\\s+'),
               lambda x: x <> '') toks
        from spaced)
""", "spaced")
define("token_n", """
  select token, cast(count(*) as bigint) n, min(doc_id * 16777216 + pos) as first from doc_tokens group by token
""", "doc_tokens")
define("vocabulary", """
  select token, cast(i as bigint) id, cast(-1 as bigint) n
  from (select unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]']) as token, unnest(range(0, 5)) i)
  union all
  select token, cast(row_number() over (order by n desc, first) + 4 as bigint), n from token_n where n >= 3
""", "token_n")


def docs(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents")


def tokenized(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "source", tx.basic_tokens(F.col("text")).alias("tokens"))


@query("clean_text", "select doc_id, body from cleaned", "cleaned")
def clean_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.clean_text(F.col("text")).alias("body"))


@query("space_cjk", f"""
  select doc_id, regexp_replace(text, '({CJK})', ' \\1 ', 'g') as body
  from (select doc_id, replace(replace(text, 'is', '漢'), 'er', '字x') as text from documents)
""")
def space_cjk(spark, sf_dir):
    # The documents hold no ideographs: two syllables are replaced by some.
    text = F.replace(F.replace("text", F.lit("is"), F.lit("漢")), F.lit("er"), F.lit("字x"))
    return docs(spark, sf_dir).select("doc_id", tx.space_cjk(text).alias("body"))


@query("lower_strip_accents", """
  select doc_id, array_to_string(list_filter(string_split_regex(strip_accents(lower(body)), '\\s+'),
                                             lambda x: x <> ''), ' ') as tokens
  from spaced
""", "spaced")
def lower_strip_accents(spark, sf_dir):
    plain = tx.lower_strip_accents(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.array_join(plain, " ").alias("tokens"))


@query("split_punctuation", f"select doc_id, regexp_replace(text, '({PUNCT})', ' \\1 ', 'g') as body from documents")
def split_punctuation(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.split_punctuation(F.col("text")).alias("body"))


@query("whitespace_tokens", """
  select doc_id, cast(length(t) as int) n, array_to_string(t, '|') as tokens
  from (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') t from documents)
""")
def whitespace_tokens(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", tx.whitespace_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n"), F.array_join("t", "|").alias("tokens"))


def counts(spark, sf_dir):
    return tx.corpus_token_counts(docs(spark, sf_dir), "doc_id")


@query("word_count_vocab", "select token, id, n from vocabulary", "vocabulary")
def word_count_vocab(spark, sf_dir):
    stored = save_and_reload(counts(spark, sf_dir), "token-counts")
    return tx.word_count_vocab(stored, 3)


@query("vocab_union", "select token, n, first from token_n", "token_n")
def vocab_union(spark, sf_dir):
    rows = save_and_reload(tokenized(spark, sf_dir), "tokens")
    halves = [F.pmod(F.xxhash64("doc_id"), F.lit(2)) == h for h in (0, 1)]
    both = tx.union_counts(*[tx.token_counts(rows.filter(h), "doc_id") for h in halves])
    return both.withColumn("first", F.col("first.ident") * (1 << 24) + F.col("first.pos"))


def stored_vocab(spark, sf_dir):
    stored = save_and_reload(word_count_vocab(spark, sf_dir), "vocabulary")
    path = shared_folder(spark, "vocab")
    tables.write_vocab(stored, path)
    return path


@query("write_vocab", "select token as line, id as line_number from vocabulary", "vocabulary")
def write_vocab(spark, sf_dir):
    lines = numbered_lines(spark, stored_vocab(spark, sf_dir))
    return lines.select(F.col("value").alias("line"), F.col("line").alias("line_number"))


@query("read_vocab", "select token, id from vocabulary", "vocabulary")
def read_vocab(spark, sf_dir):
    vocab = tables.read_vocab(spark, stored_vocab(spark, sf_dir))
    return vocab.select("token", F.col("id").cast("bigint").alias("id"))


# A piece vocabulary drawn from the documents: frequent words, and frequent letters
# and letter pairs inside words. Rare ones are missing, so unknown words occur.
define("pieces", """
  select piece as token, cast(row_number() over (order by piece) + 4 as int) id
  from (select token piece from token_n where n >= 20
        union select piece from (
          select if(i = 1, substr(token, i, 1), '##' || substr(token, i, 1)) piece, n
          from (select token, n, unnest(range(1, length(token) + 1)) i from token_n))
        group by piece having sum(n) >= 200
        union select piece from (
          select '##' || substr(token, i, 2) piece, n
          from (select token, n, unnest(range(2, length(token))) i from token_n))
        group by piece having sum(n) >= 500)
""", "token_n")
define("best", """
  select token, start, arg_max(id, len) id, max(len) len
  from (select t.token, start, len, p.id
        from (select token, start, unnest(range(1, length(token) - start + 2)) len
              from (select token, unnest(range(1, length(token) + 1)) start from token_n)) t
        join pieces p on p.token = if(start = 1, substr(t.token, start, len), '##' || substr(t.token, start, len)))
  group by token, start
""", "token_n", "pieces")
define("walk", """
  select token, cast(1 as bigint) as start, cast([] as int[]) ids from token_n
  union all
  select w.token, w.start + b.len, list_append(w.ids, b.id)
  from walk w join best b on b.token = w.token and b.start = w.start
""", "token_n", "best")
define("split_words", """
  select t.token, coalesce(w.ids, [1]) ids
  from token_n t left join walk w on w.token = t.token and w.start = length(t.token) + 1
""", "token_n", "walk")
define("encoded_docs", """
  select doc_id, flatten(list(ids order by pos)) ids
  from doc_tokens join split_words using (token) group by doc_id
""", "doc_tokens", "split_words")
define("piece_names", """
  select token, id from pieces union all select '[UNK]', 1
""", "pieces")


def stored_counts(spark, sf_dir):
    """(token, n), stored; first places are not asked for."""
    return save_and_reload(counts(spark, sf_dir).select("token", "n"), "token-counts")


def piece_vocab(spark, sf_dir, words=None):
    words = stored_counts(spark, sf_dir) if words is None else words
    at = F.posexplode(F.split("token", ""))
    letters = words.select("n", at.alias("i", "c")).filter(F.col("c") != "").select(
        F.when(F.col("i") == 0, F.col("c")).otherwise(F.concat(F.lit("##"), F.col("c"))).alias("token"), "n"
    )
    starts = F.when(F.length("token") > 2, F.sequence(F.lit(2), F.length("token") - 1))
    pairs = words.select("token", "n", F.explode(starts).alias("i")).select(
        F.concat(F.lit("##"), F.substring(F.col("token"), F.col("i"), F.lit(2))).alias("token"), "n"
    )
    frequent = lambda rows, least: rows.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("token")
    names = words.filter(F.col("n") >= 20).select("token").union(frequent(letters, 200)).union(frequent(pairs, 500))
    ranked = with_rank(names.distinct(), [], [F.col("token")], F.substring("token", 1, 2))
    ids = ranked.select("token", (F.col("rank") + 5).cast("int").alias("id"))
    unknown = ids.limit(1).select(F.lit("[UNK]").alias("token"), F.lit(1).alias("id"))
    return save_and_reload(ids.unionByName(unknown), "pieces")


@query("wordpiece", """
  select s.token, string_agg(p.token, ' ' order by k) as pieces from (
    select token, unnest(ids) id, generate_subscripts(ids, 1) k from split_words) s
  join piece_names p using (id) group by s.token
""", "split_words", "piece_names")
def wordpiece(spark, sf_dir):
    words = stored_counts(spark, sf_dir)
    split = tx.split_tokens(words.select("token"), piece_vocab(spark, sf_dir, words))
    return split.select("token", F.array_join("pieces", " ").alias("pieces"))


@query("wordpiece_joined", """
  select s.token, string_agg(p.token, ' ' order by k) as pieces from (
    select token, unnest(ids) id, generate_subscripts(ids, 1) k from split_words) s
  join piece_names p using (id) group by s.token
""", "split_words", "piece_names")
def wordpiece_joined(spark, sf_dir):
    # As for a vocabulary that fits no worker.
    words = stored_counts(spark, sf_dir)
    return tx.joined_pieces(words.select("token"), piece_vocab(spark, sf_dir, words)).select("token", F.array_join("pieces", " ").alias("pieces"))


@query("encode_documents", "select doc_id, array_to_string(ids, ' ') ids from encoded_docs", "encoded_docs")
def encode_documents(spark, sf_dir):
    rows = tx.encode_documents(docs(spark, sf_dir), piece_vocab(spark, sf_dir))
    return rows.select("doc_id", joined(F.col("ids")).alias("ids"))


@query("decode_ids", """
  select doc_id, string_agg(p.token, ' ' order by k) as tokens
  from (select doc_id, unnest(ids) id, generate_subscripts(ids, 1) k from encoded_docs)
  join piece_names p using (id) group by doc_id
""", "encoded_docs", "piece_names")
def decode_ids(spark, sf_dir):
    vocab = piece_vocab(spark, sf_dir)
    rows = tx.encode_documents(docs(spark, sf_dir), vocab)
    return tx.decode_ids(rows, vocab, "doc_id").select("doc_id", F.array_join("tokens", " ").alias("tokens"))


define("all_bytes", """
  select flow_key, rank, k, cast(('0x' || substr(head_hex, cast(2 * k - 1 as bigint), 2))::int as int) b
  from (select flow_key, rank, head_hex, unnest(range(1, 1 + length(head_hex) // 2)) k from tokens where rank < 8)
""", "tokens")


@query("token_to_id", """
  select flow_key, coalesce(string_agg(cast(b + 5 as varchar), ' ' order by rank, k) filter (b < 160), '') known,
         string_agg(cast(if(b < 160, b + 5, 1) as varchar), ' ' order by rank, k) with_unknown
  from all_bytes group by flow_key
""", "all_bytes")
def token_to_id(spark, sf_dir):
    # The byte vocabulary without its upper part, so that unknown tokens occur.
    vocab = spark.range(160).select(
        F.lower(F.lpad(F.hex("id"), 2, "0")).alias("token"), (F.col("id") + 5).cast("int").alias("id")
    )
    rows = sequences(spark, sf_dir, 8).select(
        "flow_key", F.flatten(F.transform("packets", lambda p: p["tokens"])).alias("tokens")
    )
    known = tx.token_to_id(rows, vocab, "flow_key").withColumnRenamed("ids", "known")
    every = tx.token_to_id(rows, vocab, "flow_key", skip_unknown=False)
    return known.join(every, "flow_key").select(
        "flow_key", joined(F.col("known")).alias("known"), joined(F.col("ids")).alias("with_unknown")
    )
