"""Spelling variant grouping by reduced-alphabet generation.

Letters are hashed to a few symbols. Two words that differ by one inserted, deleted or replaced
letter have reduced words that differ by at most one edit, so the partners of a word lie in
the full one-edit neighbourhood of its reduced word, which over so few symbols is short enough to
generate. The neighbourhood is joined with the reduced vocabulary, and survivors are
verified on the original strings.

A reduced word alone is a hot key: many words share it. An edit changes one place, so a
partner of known length shares the letters of its first half if the edit lies behind it, and those
of the rest otherwise. Each generated neighbour carries the hash of the half its edit leaves
alone, and each vocabulary word is listed under both halves, so that a key holds words alike in
half their letters only; no pairs of a whole group are made, and no link is lost.

Keys are 64-bit polynomial hashes updated from prefix sums, so a word of any length takes
a constant time for each neighbour; collisions only add candidates.

Roots: a form has at least ``ratio`` times the word's occurrences, so chains are logarithmic in
the largest count and pointer doubling needs the logarithm of that many rounds.

Defined cases: null text has no words; a null id counts as empty text in the noise key; repeated
rows count again; no words give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.session import save_and_reload

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = 6
MOST_KEYS = 1 << 20  # generated at once in a task

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, _U(base), dtype=_U)
    steps[:1] = _U(1)
    return np.multiply.accumulate(steps)


def with_typos(run: Column, doc_id: Column, every: int) -> Column:
    """The run, or, for one occurrence in ``every``, the run without one letter.

    The choice and the place are those of the crc32 of the id and the run.
    """
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def corpus_words(docs: DataFrame, least_letters: int = 6, least_count: int = 5, typos_every: int = 199) -> DataFrame:
    """(word, n): runs of letters in all texts, A-Z lower-cased, typos planted, by occurrences."""
    # A shorter run cannot give a word, as a typo only takes a letter away.
    runs = docs.select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all(
        F.col("text"), F.lit(LETTERS + "{%d,}" % least_letters), F.lit(0))).alias("run"))
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    words = runs.select("id", lowered.alias("run")).select(with_typos(F.col("run"), F.col("id"), typos_every).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.char_length("word") >= least_letters) & (F.col("n") >= least_count))


class _Words:
    """Words of one length as matrices: code points, symbols, and prefix sums of both."""

    def __init__(self, codes: np.ndarray, symbols: int):
        self.n, self.length = codes.shape
        self.symbols = symbols
        self.reduced = _mix(codes.astype(_U) + _U(1)) % _U(symbols) + _U(1)
        self.power = _powers(_BASE, self.length + 2)
        self.back = _powers(_INVERSE, self.length + 2)
        self.letters = self._sums(_mix(codes.astype(_U) + _U(77)))
        self.sums = self._sums(self.reduced)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, self.length + 1), dtype=_U)
        np.cumsum(values * self.power[: self.length], axis=1, out=out[:, 1:])
        return out

    def head(self, size: int) -> np.ndarray:
        """Hash of the first letters."""
        return _mix(self.letters[:, size] + _U(size))

    def tail(self, size: int) -> np.ndarray:
        """Hash of the last letters."""
        at = self.length - size
        return _mix((self.letters[:, -1] - self.letters[:, at]) * self.back[at] + _U(size)) ^ _U(0x5555555555555555)

    def _keys(self, reduced: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
        """Keys of neighbours of ``length`` letters edited at ``at`` (columns of ``reduced``)."""
        half = length // 2
        sides = np.where(at[None, :] >= half, self.head(min(half, self.length))[:, None],
                         self.tail(min(length - half, self.length))[:, None])
        return _mix(reduced * _U(length + 1) + sides)

    def own_keys(self) -> np.ndarray:
        """The two keys each word is listed under."""
        half = self.length // 2
        whole = self.sums[:, -1:] * _U(self.length + 1)
        return np.hstack([_mix(whole + self.head(half)[:, None]),
                          _mix(whole + self.tail(self.length - half)[:, None])])

    def neighbours(self, first: int, to: int) -> Iterator[np.ndarray]:
        """Keys of all words one edit away whose edit is at a place from ``first`` to ``to``."""
        total = self.sums[:, -1:]
        at = np.arange(first, min(to, self.length))
        here, after = self.sums[:, at], self.sums[:, at + 1]
        for symbol in range(1, self.symbols + 1):  # replaced; also by a letter of the same symbol
            yield self._keys(total + (_U(symbol) - self.reduced[:, at]) * self.power[at], self.length, at)
        yield self._keys(here + (total - after) * self.back[1], self.length - 1, at)
        at = np.arange(first, to)
        here = self.sums[:, at]
        for symbol in range(1, self.symbols + 1):
            yield self._keys(here + _U(symbol) * self.power[at] + (total - here) * self.power[1], self.length + 1, at)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of code points) for the words of each length."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        step = max(1, MOST_KEYS // (int(length) + 1))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            raw = "".join(words[i] for i in part.tolist()).encode("utf-32-le")
            yield part, np.frombuffer(raw, dtype=np.uint32).reshape(len(part), length)


def _listed(words: DataFrame, symbols: int) -> DataFrame:
    """(key, b): every word's id under its two keys."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for rows, codes in _by_length(batch.column("word").to_pylist()):
                own = _Words(codes, symbols).own_keys()
                yield pa.record_batch([pa.array(own.ravel().astype(np.int64)), pa.array(np.repeat(ids[rows], 2))],
                                      names=["key", "b"])

    return words.select("id", "word").mapInArrow(keys, "key bigint, b bigint")


def _generated(words: DataFrame, symbols: int) -> DataFrame:
    """(key, a): every word's id under the keys of its reduced word's one-edit neighbourhood."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for rows, codes in _by_length(batch.column("word").to_pylist()):
                group = _Words(codes, symbols)
                width = max(1, MOST_KEYS // (len(rows) * (2 * symbols + 1)))
                for first in range(0, group.length + 1, width):
                    found = np.hstack(list(group.neighbours(first, min(first + width, group.length + 1))))
                    found.sort(axis=1)  # edits within a run of one symbol give equal keys
                    fresh = np.ones(found.shape, dtype=bool)
                    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
                    yield pa.record_batch([pa.array(found[fresh].astype(np.int64)),
                                           pa.array(np.repeat(ids[rows], fresh.sum(axis=1)))], names=["key", "a"])

    return words.select("id", "word").mapInArrow(keys, "key bigint, a bigint")


def is_one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter turns one word into the other."""
    if len(a) > len(b):
        a, b = b, a
    same = len(commonprefix([a, b]))
    if len(a) == len(b):
        return a != b and a[same + 1 :] == b[same + 1 :]
    return len(b) == len(a) + 1 and a[same:] == b[same + 1 :]


@F.pandas_udf(T.BooleanType())
def _one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([is_one_edit(x, y) for x, y in zip(a, b)], dtype=bool)


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, word, b, n_b): all ordered pairs of words that differ by exactly one edit, once each.

    ``words`` is a stored table of distinct (id, word, n); a is an id, word and b are words. Only ids
    travel with the keys, so a word of any length costs the neighbourhood a few bytes a place.
    """
    pairs = _generated(words, symbols).join(_listed(words, symbols), "key").filter("a <> b")
    pairs = pairs.select("a", F.col("b").alias("b_id")).distinct()
    left = words.select(F.col("id").alias("a"), "word")
    right = words.select(F.col("id").alias("b_id"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    near = pairs.join(right, "b_id").join(left, "a").filter(_one_edit("word", "b"))
    return near.select("a", "word", "b", "n_b")


def spelling_groups(words: DataFrame, ratio: int = 5, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct (word, n).

    form: the near word of largest n (ties: smallest by code points) if that is at least ``ratio`` times
    the word's n. root: the last of the forms from the word on.
    """
    words = save_and_reload(words.withColumn("id", F.monotonically_increasing_id()), "words")
    best = near_words(words, symbols).groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("best"))
    joined = words.join(best, words["id"] == best["a"], "left")
    enough = -F.col("best.less") >= F.col("n") * ratio
    formed = save_and_reload(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.b")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    links = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = save_and_reload(links.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.filter("moved").isEmpty():
            break
        links = links.drop("moved")
    return formed.join(links.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
