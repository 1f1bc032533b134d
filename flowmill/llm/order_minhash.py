"""Order MinHash fingerprints: likeness that is sensitive to edit distance.

A text's k-mers are runs of ``k`` words, numbered by occurrence, so that a repeated
k-mer counts once for each time. A fingerprint has ``entries`` hash functions; each takes the
``SMALLEST`` k-mers of least hash, puts them back into text order and hashes the tuple.
Two texts' likeness is the share of equal entries: it falls when k-mers are replaced and also
when they are moved.

The hash functions are rotations of one: the i-th orders k-mers by (hash - i * 2^40 /
entries) mod 2^40, so its least k-mers are the first ones from a point of the circle of
sorted hashes on, and one sort serves all entries. Everything is array expressions on the row
of the text: sort packed (hash, position) integers, find runs of equal hashes (their members are
the occurrences), sort again, and pick the successors of each point.

Neighbours. ``with_neighbours`` also fingerprints an edited text, whose end is replaced by the beginning
of the next document's. The order of ids is found on ids alone, in ranges; texts are shuffled once, by
id, and serve both as the text and as the lender of its beginning.

Defined cases: null and empty texts have no k-mers, their fingerprint is the same for all of
them; texts of fewer than ``k`` words are one k-mer; with one k-mer, all entries are its hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions.arrays import let
from flowmill.session import save_and_reload

SMALLEST = 2
ENTRIES = 32
HASH_BITS, PLACE_BITS = 40, 23
_PLACES = 1 << PLACE_BITS
_NO_ID = -(1 << 63)


def with_fingerprint(df: DataFrame, text: str, out: str, *, k: int = 2, entries: int = ENTRIES) -> DataFrame:
    """``df`` with ``out``: array<bigint> of 24-bit values, one for each entry.

    A packed integer is hash * 2^23 + position; positions beyond 2^23 words share a place.
    Steps are columns of their own rather than nested lambdas: each is computed once, and the
    two sorts are of primitive arrays in generated code.
    """
    if entries & (entries - 1) or not 1 <= k:
        raise ValueError("entries must be a power of two and k at least 1")
    w, s, r, t, f = (f"_{out}_{x}" for x in "wsrtf")
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    hash_of = lambda x: F.shiftright(x, PLACE_BITS)
    short = lambda h: F.shiftrightunsigned(h, 64 - HASH_BITS)
    steps = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))

    shingles = F.col(w)
    for j in range(1, k):
        shingles = F.zip_with(shingles, F.slice(w, 1 + j, F.size(w)), lambda x, y: F.xxhash64(x, y))
    many = F.transform(F.slice(shingles, 1, F.size(w) - (k - 1)), lambda h, i: (
        short(h) * _PLACES + F.least(i, F.lit(_PLACES - 1))))
    one = F.array(short(F.xxhash64(F.array_join(F.col(w).cast("array<string>"), " "))) * _PLACES)
    none = F.array().cast("array<bigint>")
    steps = steps.withColumn(s, F.sort_array(F.when(F.size(w) >= k, many).when(F.size(w) > 0, one).otherwise(none)))

    # Later occurrences of a k-mer follow it in the sorted array; they are hashed with their number.
    again = lambda x, i: (i > 0) & (hash_of(x) == hash_of(F.get(s, i - 1)))
    steps = steps.withColumn(r, F.filter(s, again))
    numbered = F.sort_array(F.concat(F.filter(s, lambda x, i: ~again(x, i)), _numbered(F.col(r))))
    steps = steps.withColumn(t, F.when(F.size(r) == 0, F.col(s)).otherwise(numbered))

    # The circle is cut in one part for each entry: kept are each part's first hash and its successor.
    shift = HASH_BITS + PLACE_BITS - (entries.bit_length() - 1)
    part = lambda x: F.shiftright(x, shift)
    leads = lambda i: (i <= 0) | (part(F.get(t, i)) > part(F.get(t, i - 1)))
    steps = steps.withColumn(f, F.filter(t, lambda x, i: leads(i) | leads(i - 1)))
    return steps.withColumn(out, _entries(F.col(f), entries, part)).drop(w, s, r, t, f)


def _numbered(r: Column) -> Column:
    """Packed later occurrences, in order of hash and position, hashed with their number."""
    hash_of = lambda x: F.shiftright(x, PLACE_BITS)
    begins = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (
        (i == 0) | (hash_of(F.get(r, i)) != hash_of(F.get(r, i - 1)))))

    def runs(begin):
        ends = F.concat(F.slice(begin, 2, F.size(begin)), F.array(F.size(r)))
        return F.flatten(F.zip_with(begin, ends, lambda low, high: F.transform(
            F.slice(r, low + 1, high - low), lambda x, i: (
                F.shiftrightunsigned(F.xxhash64(hash_of(x), i + 1), 64 - HASH_BITS) * _PLACES
                + F.pmod(x, F.lit(_PLACES))))))

    return let(begins, runs)


def _entries(kept: Column, entries: int, part) -> Column:
    """One value for each point of the circle: the hash of its SMALLEST successors in text order."""

    def chosen(t):
        n = F.size(t)
        # How many points have their first successor at each kept hash.
        places = F.transform(t, lambda x, i: part(x) - F.when(i == 0, F.lit(-1).cast("bigint")).otherwise(
            part(F.get(t, i - 1))))
        starts = F.flatten(F.transform(places, lambda p, i: F.array_repeat(i, p.cast("int"))))
        # Points behind the last hash go on with the first one.
        return let(starts, lambda x: F.concat(x, F.array_repeat(F.lit(0), F.lit(entries) - F.size(x))))

    def tuples(t):
        def entry(i):
            a, b = F.get(t, i), F.get(t, (i + 1) % F.size(t))
            return let(F.struct((F.pmod(a, F.lit(_PLACES)) <= F.pmod(b, F.lit(_PLACES))).alias("first"), a.alias("a"), b.alias("b")), lambda p: F.pmod(
                F.when(p["first"], F.xxhash64(F.shiftright(p["a"], PLACE_BITS), F.shiftright(p["b"], PLACE_BITS)))
                .otherwise(F.xxhash64(F.shiftright(p["b"], PLACE_BITS), F.shiftright(p["a"], PLACE_BITS))),
                F.lit(1 << 24)))

        return let(chosen(t), lambda starts: F.transform(starts, entry))

    empty = F.array_repeat(F.lit(0).cast("bigint"), entries)
    return F.when(F.size(kept) > 0, let(kept, tuples)).otherwise(empty)


def fingerprint_text(entries: Column) -> Column:
    """Six hex digits for each entry."""
    return F.array_join(F.transform(entries, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries, 0 to 1."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.coalesce(equal / F.size(a), F.lit(0.0))


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next_id) of distinct ids: the next larger one, after the largest the smallest."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = save_and_reload(
        ids.select("id").repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()), "ranged")
    # One row for each range: their number is the session's number of partitions.
    firsts = ranged.groupBy("part").agg(F.min("id").alias("first"))
    ahead = F.lead("first").over(Window.orderBy("first"))
    least = F.min("first").over(Window.partitionBy(F.lit(0)))
    firsts = firsts.select("part", F.coalesce(ahead, least).alias("ahead"))
    following = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    return ranged.withColumn("following", following).join(F.broadcast(firsts), "part").select(
        "id", F.coalesce("following", "ahead").alias("next_id"))


def with_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 2) -> DataFrame:
    """(id, n_chars, edited, entries, edited_entries, next_entries) of every row.

    ``edited`` is the text with its last quarter of characters (rounded down) replaced by as many
    of the next document's, or all it has. Rows without an id have no next document, their
    edited text is just shorter. Of an id with several texts, the one of least hash is the next
    document of its predecessor. The smallest 64-bit integer stands for null and is no id.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("key"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = with_fingerprint(rows, "text", "entries", k=k).select(
        "key", (F.col("key") != _NO_ID).alias("named"), F.xxhash64("text").alias("digest"), F.length("text").alias("n_chars"),
        F.col("entries").cast("array<int>").alias("entries"))
    own = save_and_reload(own, "fingerprints")
    distinct = own.groupBy("key", "digest", "named").agg(
        F.min("n_chars").alias("n_chars"), F.min("entries").alias("entries"))
    # A stored flag rather than a condition on the key, which would be pushed to one use of the texts only.
    named = distinct.filter("named")
    order = save_and_reload(next_ids(named.select(F.col("key").alias("id")).distinct()), "order")
    # What each id lends: to whom, how much at most, and which of its texts.
    lends = named.groupBy("key").agg(F.min("digest").alias("digest"), F.max("n_chars").alias("n_chars"))
    taken = order.join(lends.select(F.col("key").alias("id"), F.expr("n_chars div 4").alias("most")), "id")
    lends = lends.drop("n_chars").join(
        taken.select(F.col("next_id").alias("key"), F.col("id").alias("borrower"), "most"), "key")
    lends = lends.join(named.select("key", "digest", F.col("entries").alias("next_entries")), ["key", "digest"])

    # Both uses have the same columns, key and join key, so that the exchange of texts is reused; the
    # digests are compared after the join, as a join key they would deal the texts anew.
    texts = rows.repartition(parts, "key")
    same_text = F.xxhash64("text").bitwiseXOR(F.col("_digest")) == 0
    lent = texts.join(lends.withColumnRenamed("digest", "_digest"), "key").filter(same_text)
    lent = lent.select(F.col("borrower").alias("key"), F.expr("substring(text, 1, most)").alias("lent"), "next_entries")
    if own.count() != lends.count():  # repeated rows lend alike
        lent = lent.dropDuplicates(["key"])
    met = texts.join(lent, "key", "left")
    n, quarter = F.length("text"), F.expr("length(text) div 4")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter),
                      F.coalesce(F.substring(F.col("lent"), F.lit(1), quarter), F.lit("")))
    met = met.join(distinct.drop("named").withColumnRenamed("digest", "_digest"), "key").filter(same_text)
    met = met.select("key", edited.alias("edited"), "n_chars", "entries", "next_entries")
    met = with_fingerprint(met, "edited", "edited_entries", k=k)
    return met.select(
        F.when(F.col("key") != _NO_ID, F.col("key")).alias(id_col), F.col("n_chars").cast("bigint"), "edited", "entries",
        F.col("edited_entries").cast("array<int>"), "next_entries")
