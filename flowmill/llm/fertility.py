"""Quality rules with tokeniser fertility.

Base rules count words, symbols, repeated lines and repeated word windows. The method's
own rule measures how a public vocabulary takes a text's words apart: characters per token,
the share of byte-fallback tokens and the entropy of the tokens relative to the largest one
their number allows. Each measure has a rejection band per language and class of token counts
(the measures scatter less in a long text): fences around the quartiles of all its documents
that pass the base rules, ``spread`` times the quartile distance away, so the bulk of a language
is never rejected whatever the vocabulary makes of it. A band is always around the language's own
median; the quartile distances of a class of few documents lean on those of the same class in all languages,
each around its own median, in proportion to the documents and only where this does not leave a small language's own quartiles out.
So no verdict turns at a count, and a clean language is kept however small; of a language of a handful of documents hardly any is rejected.

Quartiles are read off exact histograms of rounded measures, which tasks count before
anything is shuffled; a class of a language is a few thousand bins however many documents it has.

Defined cases: null and empty texts have no words and fail the base rules; a null language is a
language; texts of one token have entropy share 1; repeated rows are measured alike. Other
columns pass through ``measured``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.graph import small_enough
from flowmill.llm.tokens import WordIds, joined_ids
from flowmill.llm.words import Slice, mix, slices
from flowmill.session import save_and_reload

_U = np.uint64
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MEASURES = ("chars_per_token", "byte_share", "entropy_share")
STEPS = 1000  # histogram bins for a unit of a measure
LANGUAGES = 50_000  # most classes of languages whose fences are broadcast
_SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " n_tokens bigint, n_byte_tokens bigint, entropy double"
)
_kept: dict[str, tuple[WordIds, np.ndarray]] = {}


def _vocabulary(path: str) -> tuple[WordIds, np.ndarray]:
    """Ids of words and which ids are byte fallback; one for each Python worker."""
    if path not in _kept:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())], dtype=bool)
        _kept[path] = WordIds(lambda words: joined_ids(model.encode(words, num_threads=1))), is_byte
    return _kept[path]


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _counted(values: np.ndarray, texts: int, owner: np.ndarray) -> np.ndarray:
    """Distinct values of each text."""
    keyed = np.unique(mix(values + owner.astype(_U) * _U(0x9E3779B97F4A7C15)), return_index=True)[1]
    return np.bincount(owner[keyed], minlength=texts)


def base_counts(part: Slice) -> dict[str, np.ndarray]:
    data, bounds, rows = part.data, part.bounds, part.rows
    n_words = np.diff(part.word_bounds)
    space = np.zeros(256, dtype=bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    in_word = ~space[data] & ((data & 0xC0) != 0x80)
    # Lines with a word, as spans between line feeds and text bounds.
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([bounds[:-1], feeds + 1]))
    starts = starts[starts < len(data)] if len(data) else starts[:0]
    text_end = bounds[np.minimum(np.searchsorted(bounds, starts, side="right"), rows)]
    feed = np.append(feeds, len(data))[np.searchsorted(feeds, starts, side="left")]
    ends = np.minimum(text_end, feed)
    word_sums = np.concatenate([[0], np.cumsum(~space[data], dtype=np.int64)])
    full = word_sums[ends] > word_sums[starts]
    starts, ends = starts[full], ends[full]
    owner = np.searchsorted(bounds, starts, side="right") - 1
    lines = part.span_hasher()(starts, ends)
    dup_lines = np.bincount(owner, minlength=rows) - _counted(lines, rows, owner)
    # Windows of five words that are inside one text.
    repeat = np.zeros(rows, dtype=np.int64)
    words = part.hashes()
    if len(words) >= WINDOW:
        wide = len(words) - WINDOW + 1
        whole = np.zeros(wide, dtype=_U)
        for i in range(WINDOW):
            whole = mix(whole * _U(3) + words[i : i + wide])
        text = np.repeat(np.arange(rows), n_words)
        inside = np.flatnonzero(text[:wide] == text[WINDOW - 1 :])
        keyed = mix(whole[inside] + text[inside].astype(_U) * _U(0xC2B2AE3D27D4EB4F))
        _, inverse, count = np.unique(keyed, return_inverse=True, return_counts=True)
        twice = inside[count[inverse] > 1]
        marks = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(marks, twice, 1)
        np.add.at(marks, twice + WINDOW, -1)
        repeat = _per_text(np.cumsum(marks)[:-1] > 0, part.word_bounds)
    return {
        "n_words": n_words, "word_chars": _per_text(in_word, bounds), "n_symbols": _per_text(symbol[data], bounds),
        "n_dup_lines": dup_lines, "n_repeat_words": repeat}


def token_counts(part: Slice, vocabulary: WordIds, is_byte: np.ndarray) -> dict[str, np.ndarray]:
    ids, bounds = vocabulary.texts(part)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(part.rows, dtype=np.int64), n)
    key, count = np.unique(owner * len(is_byte) + ids, return_counts=True)
    weight = np.bincount(key // len(is_byte), weights=count * np.log2(count), minlength=part.rows)
    size = np.maximum(n, 1)
    return {"n_tokens": n, "n_byte_tokens": _per_text(is_byte[ids], bounds), "entropy": np.log2(size) - weight / size}


def measured(docs: DataFrame, vocabulary: str, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) and the counts of each row's whole text."""
    keep = docs.columns if keep is None else keep
    at = len(keep)
    wide = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", " + _SCHEMA

    def run(batches):
        words, is_byte = _vocabulary(vocabulary)
        for batch in batches:
            found: dict[str, list] = {}
            for part in slices(batch.column(at)):
                for name, values in (base_counts(part) | token_counts(part, words, is_byte)).items():
                    found.setdefault(name, []).append(values)
            if not found:
                continue
            added = {name: np.concatenate(values) for name, values in found.items()}
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], *[pa.array(v.astype(np.float64 if n == "entropy" else np.int64))
                                        for n, v in added.items()]], names=[*keep, *added])

    return wide.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _measures(counts: DataFrame) -> DataFrame:
    tokens = F.greatest("n_tokens", F.lit(1))
    most = F.log2(tokens)
    return counts.withColumns({
        "chars_per_token": F.col("word_chars") / tokens, "byte_share": F.col("n_byte_tokens") / tokens,
        "entropy_share": F.when(most > 0, F.col("entropy") / most).otherwise(1.0)})


def _quartiles(counted: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, q1, q2, q3, docs) of bins counted by (keys, measure, bin)."""
    own = Window.partitionBy(*keys, "measure")
    counted = counted.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("docs", F.sum("n").over(own))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("docs"), F.col("bin")))
    return counted.groupBy(*keys, "measure").agg(
        at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"), F.max("docs").alias("docs"))


def _class() -> Column:
    """Doublings of the token count, from 16 to 16,384: in a short text the measures scatter more."""
    return F.least(F.greatest(F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))), F.lit(4)), F.lit(14)).cast("int")


def _lang_key(lang_col: str) -> Column:
    return F.concat(F.lit("="), F.coalesce(F.col(lang_col).cast("string"), F.lit("-null")))


def fences(counts: DataFrame, lang_col: str, *, spread: float, least_docs: int) -> DataFrame:
    """(_lang, _class, low and high of each measure) for the languages and token-count classes of good documents."""
    good = _measures(counts).filter(~base_failed())
    bins = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * STEPS).cast("bigint").alias("bin"))
                               for m in MEASURES]))
    counted = good.select(_lang_key(lang_col).alias("_lang"), _class().alias("_class"), bins.alias("b")).groupBy(
        "_lang", "_class", "b.measure", "b.bin").agg(F.count(F.lit(1)).alias("n"))
    counted = save_and_reload(counted, "histogram")
    # Bins become distances from the language's median, so that classes of all languages can be laid together.
    centres = _quartiles(counted, "_lang").select(
        "_lang", "measure", F.col("docs").alias("lang_docs"), F.col("q2").alias("centre"))
    away = counted.join(centres, ["_lang", "measure"]).withColumn("bin", F.col("bin") - F.col("centre"))
    away = save_and_reload(away, "histogram")
    # A class of few documents leans on the class in all languages, and that on all classes (1, 3) by the root of the tokens.
    middle = away.groupBy("measure").agg((F.sum(F.col("_class") * F.col("n")) / F.sum("n")).alias("middle"))
    whole = _quartiles(away).join(middle, "measure").select(
        "measure", F.col("q1").alias("w1"), F.col("q3").alias("w3"), "middle")
    wider = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("middle") - F.col("_class")) / 2))
    lean = lambda own, other, docs: (F.col(docs) * F.col(own) + F.lit(PRIOR_DOCS) * other) / (F.col(docs) + F.lit(PRIOR_DOCS))
    pool = _quartiles(away, "_class").join(F.broadcast(whole), "measure").select(
        "_class", "measure", *[lean(f"q{i}", F.col(f"w{i}") * wider, "docs").alias(f"p{i}") for i in (1, 3)])
    cells = _quartiles(away, "_lang", "_class").join(F.broadcast(pool), ["_class", "measure"]).join(centres, ["_lang", "measure"])
    # The fewer documents a language has, the more its own quartiles are inside whatever others say.
    few = F.lit(least_docs) / (F.col("lang_docs") + F.lit(least_docs))
    leant = {i: lean(f"q{i}", F.col(f"p{i}"), "docs") for i in (1, 3)}
    cells = cells.withColumns({
        "q1": leant[1] - few * F.greatest(leant[1] - F.col("q1"), F.lit(0.0)),
        "q3": leant[3] + few * F.greatest(F.col("q3") - leant[3], F.lit(0.0))})
    wide = spread * F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_DISTANCE * STEPS))
    side = {"low": F.col("centre") + F.col("q1") - wide, "high": F.col("centre") + F.col("q3") + wide}
    return cells.groupBy("_lang", "_class").agg(*[
        F.max(F.when(F.col("measure") == m, at / F.lit(float(STEPS)))).alias(f"{m}_{name}")
        for m in MEASURES for name, at in side.items()])


LEAST_DISTANCE = 0.02  # of quartiles, so that a language of equal documents has a band
PRIOR_DOCS = 20  # documents of a class that weigh as much as the class in all languages


def judged(counts: DataFrame, *, lang_col: str = "lang", spread: float = 2.0, least_docs: int = 200) -> DataFrame:
    """``counts`` (read twice: store it) with measures, base_failed and kept.

    Too few characters for a token, too many byte tokens, too little entropy, and their
    opposites where they are out of the band reject a document; a higher entropy does not.
    """
    bands = small_enough(fences(counts, lang_col, spread=spread, least_docs=least_docs), LANGUAGES)
    rows = _measures(counts).withColumns({"_lang": _lang_key(lang_col), "_class": _class()})
    rows = rows.join(bands, ["_lang", "_class"], "left")
    outside = F.lit(False)
    for m in MEASURES:
        outside = outside | F.coalesce(F.col(m) < F.col(f"{m}_low"), F.lit(False))
        if m != "entropy_share":
            outside = outside | F.coalesce(F.col(m) > F.col(f"{m}_high"), F.lit(False))
    failed = base_failed()
    return rows.withColumns({"base_failed": failed, "kept": ~failed & ~outside}).select(
        *counts.columns, *MEASURES, "base_failed", "kept")
