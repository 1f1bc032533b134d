"""Text tokenization and vocabularies as corpus jobs.

Cleaning and splitting into words are JVM expressions. What Spark has no function
for (accent stripping, longest-match pieces) runs in an Arrow UDF once per
distinct word of a batch; no word is ever shuffled for it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.functions.arrays import let
from flowmill.functions.ranking import with_rank
from flowmill.operators.encode import UNK
from flowmill.session import save_and_reload

# Fixed values.
RESERVED_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
MAX_WORD = 200
CJK_RANGES = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
)
ASCII_PUNCTUATION = ((33, 47), (58, 64), (91, 96), (123, 126))

MAX_VOCAB_BYTES = 256 << 20
ENTRY_BYTES = 200  # of a dictionary entry, besides the token's text
CACHED_WORDS, CACHED_LENGTH = 1 << 18, 256
SLICE_WORDS = 1 << 20
PIECE_SALTS = 8
RESIDUES = 1 << 20  # most values of the filter that spans pass before they are moved
IDS = 1 << 33  # ids and null, in the low bits of a match


def _class(ranges) -> str:
    return "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in ranges)


def clean_text(text: Column) -> Column:
    """Tabs, newlines and Unicode blanks -> blank; control characters removed."""
    blanks = F.regexp_replace(text, r"[\t\n\r\p{Zs}]", " ")
    return F.regexp_replace(blanks, r"[\p{Cc}\p{Cf}\x{FFFD}]", "")


def space_cjk(text: Column) -> Column:
    """A blank on both sides of every CJK ideograph."""
    return F.regexp_replace(text, f"([{_class(CJK_RANGES)}])", " $1 ")


def split_punctuation(text: Column) -> Column:
    """Blanks around every punctuation character."""
    return F.regexp_replace(text, f"([{_class(ASCII_PUNCTUATION)}\\p{{P}}])", " $1 ")


def whitespace_tokens(text: Column) -> Column:
    """Split on runs of blanks; no empty tokens."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def words(text: Column) -> Column:
    """Words as they stand, before cleaning.

    Splits exactly where the cleaned text would split: at tabs, newlines and the
    space, line and paragraph separators. What cleaning removes stays inside a
    word and is removed there, once per distinct word.
    """
    return F.filter(F.split(text, r"[\t\n\r\p{Z}]+"), lambda x: x != "")


# Characters that stand for themselves in a clean word: no control, no ideograph.
_FAST = re.compile(r"[!-~]*")
_PUNCT = re.compile(r"[!-/:-@\[-`{-~]")


@lru_cache(maxsize=65536)
def _character(char: str) -> str:
    """What a character of a word becomes in the cleaned, spaced text."""
    if char == "\ufffd" or unicodedata.category(char) in ("Cc", "Cf"):
        return ""
    code = ord(char)
    return f" {char} " if any(a <= code <= b for a, b in CJK_RANGES) else char


def _plain(word: str) -> str:
    """Lower case, accents removed."""
    if word.isascii():
        return word.lower()
    decomposed = unicodedata.normalize("NFD", word.lower())
    return "".join(c for c in decomposed if c.isascii() or unicodedata.category(c) != "Mn")


@lru_cache(maxsize=65536)
def _punctuation(char: str) -> bool:
    code = ord(char)
    return any(a <= code <= b for a, b in ASCII_PUNCTUATION) or unicodedata.category(char)[0] == "P"


def _basic(word: str) -> list[str]:
    """Tokens of one word of :func:`words`."""
    if _FAST.fullmatch(word):
        plain = word.lower()
        return [plain] if plain.isalnum() else _PUNCT.sub(r" \g<0> ", plain).split()
    out: list[str] = []
    for part in "".join(map(_character, word)).split():
        plain = _plain(part)
        if plain.isalnum():
            out.append(plain)
        else:
            out += "".join(f" {c} " if _punctuation(c) else c for c in plain).split()
    return out


def _plain_words(word: str) -> list[str]:
    return [_plain(p) for p in "".join(map(_character, word)).split()]


class _Pieces:
    """Greedy longest match over a vocabulary of whole-word and ``##`` pieces."""

    def __init__(self, vocab: dict, unknown):
        self.heads, self.unknown = vocab, [unknown]
        self.tails = {t[2:]: v for t, v in vocab.items() if t.startswith("##")}
        self.longest = max(map(len, vocab), default=1)

    def __call__(self, token: str) -> list:
        if len(token) > MAX_WORD:
            return self.unknown
        found, start, table = [], 0, self.heads
        while start < len(token):
            for end in range(min(len(token), start + self.longest), start, -1):
                value = table.get(token[start:end])
                if value is not None:
                    break
            else:
                return self.unknown
            found.append(value)
            start, table = end, self.tails
        return found


def per_distinct_word(make: Callable[[], Callable[[str], list]], element: T.DataType, cached: int = CACHED_WORDS):
    """Arrow UDF array -> array<element> replacing each word, id or null in the array by a list.

    ``make()`` is called once per task; its function runs once per distinct word
    of a slice, with the results of ``cached`` frequent words kept between slices: 0 where no word comes twice. A
    batch is worked off in slices of bounded length, so a worker holds one batch as Spark bounds it and little else.
    """
    arrow_type = {T.IntegerType: pa.int32(), T.StringType: pa.string()}[type(element)]

    @F.arrow_udf(T.ArrayType(element))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        plain = make()
        known = lru_cache(maxsize=cached)(plain)
        for arr in batches:
            for first, n in _slices(arr):
                yield _replaced(arr.slice(first, n), plain, known, arrow_type)
            arr = None  # not held while the next one is read

    return run


def _slices(arr: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices of at most ``SLICE_WORDS`` words, or of one row."""
    ends = np.cumsum(np.asarray(arr.value_lengths().fill_null(0)), dtype=np.int64)
    first, before = 0, 0
    while first < len(arr):
        last = max(first + 1, int(np.searchsorted(ends, before + SLICE_WORDS, "right")))
        yield first, last - first
        first, before = last, int(ends[last - 1])


def _replaced(arr: pa.Array, plain: Callable[[str], list], known: Callable[[str], list], arrow_type: pa.DataType) -> pa.Array:
    counts = np.asarray(arr.value_lengths().fill_null(0))
    coded = arr.flatten().dictionary_encode(null_encoding="encode")
    found = [plain(w) if type(w) is str and len(w) > CACHED_LENGTH else known(w) for w in coded.dictionary.to_pylist()]
    lists = pa.array(found, pa.list_(arrow_type))
    spread = lists.take(coded.indices)
    reach = np.concatenate([[0], np.cumsum(np.asarray(spread.value_lengths()))])
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(reach[ends], pa.int32()), spread.flatten())


def lower_strip_accents(text: Column) -> Column:
    """Words of the text, cleaned, in lower case and without accents."""
    return per_distinct_word(lambda: _plain_words, T.StringType())(words(text))


def basic_tokens(text: Column) -> Column:
    """Text -> lower-case tokens without accents, punctuation split off."""
    return per_distinct_word(lambda: _basic, T.StringType())(words(text))


def vocab_lookup(vocab: DataFrame, most_bytes: int = MAX_VOCAB_BYTES):
    """Broadcast token -> id if the vocabulary takes at most ``most_bytes`` in a worker, else None.

    Without it, :func:`split_tokens` and :func:`encode_documents` find pieces by joins.
    """
    size = vocab.agg(F.sum(F.octet_length("token") + ENTRY_BYTES)).first()[0] or 0
    if size > most_bytes:
        return None
    rows = vocab.select("token", "id").toPandas()
    table = dict(zip(rows["token"], (int(i) for i in rows["id"])))
    return vocab.sparkSession.sparkContext.broadcast(table)


def wordpiece_ids(tokens: Column, lookup) -> Column:
    """Tokens -> piece ids by greedy longest match."""
    def make():
        table = lookup.value
        return _Pieces(table, table.get("[UNK]", UNK))

    return per_distinct_word(make, T.IntegerType())(tokens)


def wordpieces(tokens: Column, lookup) -> Column:
    """Tokens -> piece texts."""
    def make():
        return _Pieces({token: token for token in lookup.value}, "[UNK]")

    return per_distinct_word(make, T.StringType())(tokens)


def split_tokens(tokens: DataFrame, vocab: DataFrame, most_bytes: int = MAX_VOCAB_BYTES) -> DataFrame:
    """(token, pieces, ids) of distinct tokens by greedy longest match, for a vocabulary of any size."""
    lookup = vocab_lookup(vocab, most_bytes)
    if lookup is None:
        return joined_pieces(tokens, vocab)
    one = F.array("token")
    return tokens.select("token", wordpieces(one, lookup).alias("pieces"), wordpiece_ids(one, lookup).alias("ids"))


def joined_pieces(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(token, pieces, ids) of distinct tokens by a join with the vocabulary.

    Every substring a vocabulary entry could match, no longer than its longest one, meets the
    vocabulary in one join; the longest match at each place is kept, and the walk from match to match is an
    array expression on the token's own matches, at most one for each of its letters. Tokens are dealt out before they are
    taken apart, and a substring whose hash has a residue that no entry has is dropped where it is made, so few rows
    that are no match move. A match is one number: its size and, below ``IDS``, its id.
    """
    known = vocab.groupBy("token").agg(F.max("id").alias("id"))
    longest = known.agg(F.max(F.char_length("token")).alias("longest"))
    unknown = known.filter(F.col("token") == "[UNK]").agg(F.coalesce(F.max("id"), F.lit(UNK)).alias("unknown"))
    length = F.char_length("token")
    tokens = tokens.repartition("token")
    places = tokens.filter(length <= MAX_WORD).crossJoin(F.broadcast(longest)).select(
        "token", "longest", F.explode(F.sequence(F.lit(1), length)).alias("place"))
    reach = F.least(F.col("longest"), length - F.col("place") + 1)
    spans = places.select("token", "place", F.explode(F.sequence(F.lit(1), reach)).alias("size"))
    piece = lambda place, size: F.concat(
        F.when(place == 1, F.lit("")).otherwise(F.lit("##")), F.substring(F.col("token"), place, size))
    spans = spans.withColumn("piece", piece(F.col("place"), F.col("size")))
    residue = lambda text: F.pmod(F.xxhash64(text), F.lit(RESIDUES))
    likely = F.broadcast(known.select(residue("token").alias("_residue")).distinct())
    spans = spans.withColumn("_residue", residue("piece")).join(likely, "_residue", "left_semi").drop("_residue")
    # A piece of one letter may be a third of all rows: the vocabulary is dealt out once for each salt.
    salt = F.pmod(F.xxhash64("token"), F.lit(PIECE_SALTS))
    dealt = known.select(F.col("token").alias("piece"), "id", F.explode(F.sequence(F.lit(0), F.lit(PIECE_SALTS - 1))).alias("_salt"))
    found = spans.withColumn("_salt", salt.cast("int")).join(dealt, ["piece", "_salt"])
    low = F.coalesce(F.col("id").cast("int").cast("bigint") + (1 << 31) + 1, F.lit(0))
    best = found.groupBy("token", "place").agg(F.max(F.col("size").cast("bigint") * IDS + low).alias("best"))
    matches = best.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("place").alias("key"), F.col("best").alias("value")))).alias("_at"))
    rows = tokens.join(matches, "token", "left").crossJoin(F.broadcast(unknown))
    kind = "struct<place:int,pieces:array<string>,ids:array<int>>"
    start = F.struct(F.lit(1).alias("place"), F.array().alias("pieces"), F.array().alias("ids")).cast(kind)

    def step(state, _):
        def reached(match):
            size, low = F.floor(match / IDS).cast("int"), F.pmod(match, F.lit(IDS))
            ident = F.when(low > 0, (low - (1 << 31) - 1).cast("int"))
            return F.when(match.isNull(), state).otherwise(F.struct(
                (state["place"] + size).alias("place"), F.concat(state["pieces"], F.array(piece(state["place"], size))).alias("pieces"),
                F.concat(state["ids"], F.array(ident)).alias("ids")).cast(kind))

        return let(F.element_at("_at", state["place"]), reached)

    most = F.when(F.col("_at").isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.char_length("token")))
    rows = rows.withColumn("_walk", F.aggregate(most, start, step))
    whole = F.col("_at").isNotNull() & (F.col("_walk.place") == F.char_length("token") + 1)
    return rows.select(
        "token", F.when(whole, F.col("_walk.pieces")).otherwise(F.array(F.lit("[UNK]"))).alias("pieces"),
        F.when(whole, F.col("_walk.ids")).otherwise(F.array(F.col("unknown").cast("int"))).alias("ids"))


def encode_documents(docs: DataFrame, vocab, text: str = "text", most_bytes: int = MAX_VOCAB_BYTES) -> DataFrame:
    """Add ``ids``: the text's piece ids. ``vocab`` is a table (token, id) or a looked-up broadcast of one.

    With a broadcast vocabulary it is one pass over the text in one UDF. A larger vocabulary is joined with the
    distinct tokens of the corpus, and those with the words of the texts.
    """
    lookup = vocab_lookup(vocab, most_bytes) if isinstance(vocab, DataFrame) else vocab
    if lookup is None:
        return _encoded_by_joins(docs, vocab, text)

    def make():
        table = lookup.value
        pieces = _Pieces(table, table.get("[UNK]", UNK))
        return lambda word: [i for token in _basic(word) for i in pieces(token)]

    return docs.withColumn("ids", per_distinct_word(make, T.IntegerType())(words(F.col(text))))


def _encoded_by_joins(docs: DataFrame, vocab: DataFrame, text: str) -> DataFrame:
    stored = save_and_reload(docs.withColumn("_row", F.monotonically_increasing_id()), "texts")
    places = stored.select("_row", F.posexplode(words(F.col(text))).alias("_pos", "word"))
    split = per_distinct_word(lambda: _basic, T.StringType(), cached=0)(F.array("word"))
    distinct = save_and_reload(places.select("word").distinct().withColumn("_tokens", split), "words")
    tokens = distinct.select(F.explode("_tokens").alias("token")).distinct()
    pieces = save_and_reload(joined_pieces(tokens, vocab), "pieces").select("token", "ids")
    of_word = distinct.select("word", F.posexplode("_tokens").alias("_pos", "token")).join(pieces, "token").groupBy("word").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "ids"))), lambda x: x["ids"])).alias("_ids"))
    # Frequent words are hot keys of this join; Spark splits them, and the other side has one row a word.
    found = places.join(of_word, "word").groupBy("_row").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_ids"))), lambda x: x["_ids"])).alias("ids"))
    return stored.join(found, "_row", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>"))).drop("_row")


def token_to_id(
    df: DataFrame, vocab: DataFrame, key: str, tokens: str = "tokens", skip_unknown: bool = True,
    most_bytes: int = MAX_VOCAB_BYTES,
) -> DataFrame:
    """(key, ids): for each row the ids of its tokens, in order.

    Unknown and null tokens are skipped or become [UNK]; no tokens or null give no ids. A token that the
    vocabulary holds twice has its largest id. With a vocabulary of at most ``most_bytes`` this is one pass without a
    shuffle; the tokens of a larger one are found by a salted join.
    """
    known = vocab.groupBy("token").agg(F.max("id").alias("id"))
    lookup = vocab_lookup(known, most_bytes)
    unknown = [] if skip_unknown else [UNK]
    if lookup is None:
        listed = F.when(F.col("value").isNotNull(), F.array(F.col("value").cast("int"))).otherwise(
            F.array(*map(F.lit, unknown)).cast("array<int>"))
        return _found_by_join(df, key, tokens, known.select(F.col("token").alias("entry"), F.col("id").alias("value")), listed, "ids")

    def make():
        table = lookup.value
        return lambda token: [table[token]] if token in table else unknown

    return df.select(key, per_distinct_word(make, T.IntegerType())(F.col(tokens)).alias("ids"))


def decode_ids(
    df: DataFrame, vocab: DataFrame, key: str, ids: str = "ids", most_bytes: int = MAX_VOCAB_BYTES
) -> DataFrame:
    """(key, tokens): for each row the tokens of its ids, in order.

    No ids or null give no tokens; an id that the vocabulary lacks gives a null. An id held twice is the
    least of its tokens. Vocabularies of any size, as in :func:`token_to_id`.
    """
    known = vocab.groupBy(F.col("id").cast("bigint").alias("id")).agg(F.min("token").alias("token"))
    lookup = vocab_lookup(known, most_bytes)
    if lookup is None:
        entries = known.select(F.col("id").alias("entry"), F.col("token").alias("value"))
        return _found_by_join(df, key, ids, entries, F.array("value"), "tokens")

    def make():
        table = {ident: token for token, ident in lookup.value.items()}
        return lambda ident: [table.get(ident)]

    return df.select(key, per_distinct_word(make, T.StringType())(F.col(ids)).alias("tokens"))


def _found_by_join(
    df: DataFrame, key: str, items: str, entries: DataFrame, listed: Column, name: str
) -> DataFrame:
    """(key, name): for each row the lists ``listed`` of its items in a row, by a join with (entry, value)."""
    stored = save_and_reload(df.select(
        F.col(key).alias("_key"), F.col(items).alias("_items"), F.monotonically_increasing_id().alias("_row")), "items")
    places = stored.select("_row", F.posexplode("_items").alias("_pos", "entry"))
    # One item may be a third of all: the vocabulary is dealt out once for each salt.
    places = places.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(PIECE_SALTS)).cast("int"))
    dealt = entries.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(PIECE_SALTS - 1))))
    found = places.join(dealt, ["entry", "_salt"], "left").select("_row", "_pos", listed.alias("_list"))
    rows = found.groupBy("_row").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("_pos", "_list"))), lambda p: p["_list"])).alias("_lists"))
    kind = rows.schema["_lists"].dataType
    return stored.join(rows, "_row", "left").select(
        F.col("_key").alias(key), F.coalesce("_lists", F.array().cast(kind)).alias(name))


def token_counts(docs: DataFrame, ident: str, tokens: str = "tokens") -> DataFrame:
    """(token, n, first): occurrences and first place, both combined map-side.

    ``first`` is a struct (ident, pos), so ids of any size or type keep their order.
    """
    # The outer form: from the inner one Spark infers a filter on the array's size,
    # which would run the tokenizer a second time.
    rows = docs.select(ident, F.posexplode_outer(tokens).alias("_pos", "token")).filter(
        F.col("token").isNotNull()
    )
    place = F.struct(F.col(ident).alias("ident"), F.col("_pos").alias("pos"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))


def corpus_token_counts(docs: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(token, n, first, at) of raw texts, tokenizing each distinct word only once.

    Words are counted in the JVM before they are split into tokens, so Python
    sees the distinct words of the corpus and not its text. ``first`` is the
    place of the first word with the token, ``at`` the token's place in it.
    """
    places = docs.select(ident, F.posexplode_outer(words(F.col(text))).alias("_pos", "word")).filter(
        F.col("word").isNotNull()
    )
    place = F.struct(F.col(ident).alias("ident"), F.col("_pos").alias("pos"))
    distinct = places.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    split = per_distinct_word(lambda: _basic, T.StringType(), cached=0)(F.array("word"))
    tokens = (
        distinct.withColumn("_tokens", split)
        .select("n", "first", "_tokens", F.explode_outer("_tokens").alias("token"))
        .filter(F.col("token").isNotNull())
        .withColumn("at", F.array_position("_tokens", F.col("token")))
    )
    return tokens.groupBy("token").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.min_by("at", "first").alias("at")
    )


def union_counts(*parts: DataFrame) -> DataFrame:
    """Union of per-part counts: summed, first place kept."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("token").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _ident_bucket(df: DataFrame, ident: str) -> Column:
    """A coarser value in the same order: numbers by 4096, texts by their beginning."""
    kind = df.select(F.col(ident).alias("i")).schema["i"].dataType
    return F.shiftright(F.col(ident), 12) if isinstance(kind, T.IntegralType) else F.substring(F.col(ident).cast("string"), 1, 4)


def word_count_vocab(counts: DataFrame, min_count: int = 1) -> DataFrame:
    """(token, id, n): reserved tokens first with n = -1, then by count and first place."""
    spark = counts.sparkSession
    kept = counts.filter((F.col("n") >= min_count) & ~F.col("token").isin(*RESERVED_TOKENS))
    ranked = with_rank(
        kept, [], [F.desc("n"), *[F.col(c) for c in ("first", "at") if c in kept.columns]],
        F.struct((-F.col("n")).alias("n"), _ident_bucket(kept, "first.ident").alias("at")),
    )
    reserved = spark.createDataFrame(
        [(t, i, -1) for i, t in enumerate(RESERVED_TOKENS)], "token string, id bigint, n bigint"
    )
    return reserved.unionByName(
        ranked.select("token", (F.col("rank") + len(RESERVED_TOKENS)).alias("id"), "n")
    )
