"""Ordinal cumulative-link regression on graded ratings.

P(grade >= k | x) = sigmoid(w.x - t_k) with one weight vector over hashed text features
for all grades and ordered thresholds t_1 < t_2 < ... A document gets its expected grade
and the tail probability of reaching the accepted grade, by which it is selected.

Features of a whole text: presence of each hashed word (A-Z lower-cased) and of each word beginning
of a few lengths, which inflected forms share, the share of words of each shape (last two characters where they are punctuation, capitals, digits), and
one-hot classes of length and of the share of distinct words.

Fitting takes at most ``most_labelled`` labelled rows, those with the smallest hash of
their id; everything else runs over all rows. A fifth of the sample is held out and sets
the tail threshold. Fitted weights are a fixed number of floats, sent to the tasks.

Defined cases: null text is empty, empty texts are scored like others. Labels with a null grade or id,
or without a document, are no sample; an id rated twice has its lowest grade. Without labels of two grades nothing
can be fitted: every document gets the top grade with probability 1. Repeated rows are scored alike. Other
columns pass through; ``expected_grade``, ``tail_probability`` and ``accepted`` replace columns of these names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowmill.llm.ngram_jaccard import shingle_sets
from flowmill.llm.words import Slice, mix, slices
from flowmill.session import save_and_reload

WORD_BITS = 19
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes
SHAPES = 1 << 12
CLASSES = 64
SIZE = (1 << WORD_BITS) + SHAPES + CLASSES
SHAPE_SCALE = 8.0
LEAST_CHI2, LEAST_SEEN = 40.0, 8  # of features that are fitted


_KIND = np.zeros(256, dtype=np.int64)  # ASCII punctuation by code, all letters alike
for _code in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)):
    _KIND[_code] = _code - 32


def _spans_sum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[high] - sums[low]


def text_features(part: Slice, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, features, values): the features of each text of a slice; of words only those ``wanted``."""
    n = np.diff(part.word_bounds)
    doc = np.repeat(np.arange(part.rows, dtype=np.int64), n)
    hashed = part.span_hasher(lower=True)
    bucket = lambda h: (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    ends = part.ends.copy()  # without ASCII punctuation behind
    for _ in range(3):
        ends -= (ends > part.starts + 1) & (_KIND[part.data[ends - 1]] > 0)
    begun = []

    def note(docs, buckets):
        if wanted is not None:
            kept = wanted[buckets]
            docs, buckets = docs[kept], buckets[kept]
        begun.append(np.unique(docs * (1 << WORD_BITS) + buckets))

    whole = bucket(hashed(part.starts, ends))
    distinct = np.bincount(np.unique(doc * (1 << WORD_BITS) + whole) >> WORD_BITS, minlength=part.rows)
    note(doc, whole)
    for size in BEGINNINGS:
        long = np.flatnonzero(ends - part.starts > size)
        start = part.starts[long]
        note(doc[long], bucket(mix(hashed(start, start + size) + np.uint64(size))))
    present = np.unique(np.concatenate(begun))

    data, last = part.data, part.ends - 1
    before = np.maximum(last - 1, part.starts)
    upper = _spans_sum((data >= 65) & (data <= 90), part.starts, part.ends) if len(data) else n[:0]
    lower = _spans_sum((data >= 97) & (data <= 122), part.starts, part.ends) if len(data) else n[:0]
    digit = _spans_sum((data >= 48) & (data <= 57), part.starts, part.ends) if len(data) else n[:0]
    shape = _KIND[data[last]] * 31 + (_KIND[data[before]] > 0) * 8
    shape = (shape + (upper > lower) * 4 + (digit > 0) * 2) % SHAPES
    shaped, count = np.unique(doc * SHAPES + shape, return_counts=True)

    share = np.where(n > 0, np.minimum(15, 16 * distinct // np.maximum(n, 1)), 16)
    length = np.minimum(31, np.ceil(np.log2(n + 1)).astype(np.int64))
    rows = np.arange(part.rows, dtype=np.int64)
    # Short texts have mostly distinct words, so the share counts within a length.
    features = np.concatenate([
        present & ((1 << WORD_BITS) - 1), (1 << WORD_BITS) + shaped % SHAPES,
        (1 << WORD_BITS) + SHAPES + np.minimum(length, 15) // 4 * 16 + np.minimum(share, 15)])
    owner = np.concatenate([present >> WORD_BITS, shaped // SHAPES, rows])
    values = np.concatenate([
        np.ones(len(present)), SHAPE_SCALE * count / np.maximum(n, 1)[shaped // SHAPES], np.ones(part.rows)])
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(part.rows + 1))
    return bounds, features[order].astype(np.int32), values[order].astype(np.float32)


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one for each grade above the lowest
    accept: float = 0.5  # least tail probability

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. of each score."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _scores(weights, bounds, features, values):
    sums = np.concatenate([[0.0], np.cumsum(weights[features] * values, dtype=np.float64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _minimised(value_and_gradient, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, gradient = value_and_gradient(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        direction, kept = -gradient, []
        for s, y, r in reversed(moves):
            kept.append(r * (s @ direction))
            direction -= kept[-1] * y
        if moves:
            s, y, _r = moves[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y, r), k in zip(moves, reversed(kept)):
            direction += (k - r * (y @ direction)) * s
        slope, size = gradient @ direction, 1.0 if moves else 1.0 / max(1.0, np.abs(gradient).sum())
        for _ in range(25):
            new = x + size * direction
            new_value, new_gradient = value_and_gradient(new)
            if new_value <= value + 1e-4 * size * slope:
                break
            size *= 0.5
        else:
            break
        s, y = new - x, new_gradient - gradient
        if s @ y > 1e-12:
            moves = [*moves[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = abs(value - new_value) <= 1e-6 * max(1.0, abs(value))
        x, value, gradient = new, new_value, new_gradient
        if done:
            break
    return x


def fit(bounds, features, values, grades: np.ndarray, n_grades: int, *, steps: int = 100, l2: float = 0.1) -> OrdinalModel:
    """Penalised maximum likelihood over all rows; grades weigh alike."""
    rows = len(grades)
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    used, column = np.unique(features, return_inverse=True)
    counts = np.bincount(grades, minlength=n_grades)
    own = (rows / np.maximum(counts, 1) / max(1, (counts > 0).sum()))[grades]
    at = np.arange(rows)

    def value_and_gradient(x):
        weights, free = x[: len(used)], x[len(used) :]
        # Thresholds as a first one and positive steps keep their order.
        thresholds = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        scores = np.bincount(owner, weights=weights[column] * values, minlength=rows)
        upper = np.concatenate([np.ones((rows, 1)), _sigmoid(scores[:, None] - thresholds)], 1)
        upper = np.concatenate([upper, np.zeros((rows, 1))], 1)
        slope = upper * (1 - upper)
        chance = np.maximum(upper[at, grades] - upper[at, grades + 1], 1e-12)
        value = -(own * np.log(chance)).sum() + 0.5 * l2 * (weights @ weights) + 0.01 * (free @ free)
        by_score = -(slope[at, grades] - slope[at, grades + 1]) / chance * own
        by_threshold = np.zeros((rows, n_grades + 1))
        by_threshold[at, grades] += slope[at, grades] / chance * own
        by_threshold[at, grades + 1] -= slope[at, grades + 1] / chance * own
        by_free = np.cumsum(by_threshold[:, 1:n_grades].sum(0)[::-1])[::-1]
        by_free[1:] *= np.exp(free[1:])
        by_weight = np.bincount(column, weights=by_score[owner] * values, minlength=len(used)) + l2 * weights
        return value, np.concatenate([by_weight, by_free + 0.02 * free])

    x = _minimised(value_and_gradient, np.zeros(len(used) + n_grades - 1), steps)
    weights = np.zeros(SIZE, dtype=np.float32)
    weights[used] = x[: len(used)]
    free = x[len(used) :]
    return OrdinalModel(weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def _calibrated(tail: np.ndarray, good: np.ndarray) -> float:
    """The tail probability that divides good from other held-out rows with the fewest errors, each side's share alike."""
    if good.all() or not good.any():
        return 0.5
    cuts = np.unique(np.concatenate([tail, [0.5]]))
    kept = 1 - np.searchsorted(np.sort(tail[good]), cuts, side="left") / good.sum()
    gone = np.searchsorted(np.sort(tail[~good]), cuts, side="left") / (~good).sum()
    value = kept + gone
    best = np.flatnonzero(value >= value.max() - 1e-12)
    low = cuts[max(best[0] - 1, 0)]
    return float((low + cuts[best[-1]]) / 2)


def fit_grades(docs: DataFrame, grades: DataFrame, *, n_grades: int, accept_grade: int, most_labelled: int = 20_000,
               id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on the bounded sample of ``grades`` (id, grade from 0) that has documents."""
    nothing = OrdinalModel(np.zeros(SIZE, dtype=np.float32), np.full(n_grades - 1, -50.0), 0.0)
    known = grades.select(F.col(id_col).alias("id"), F.col("grade").cast("int").alias("grade"))
    known = known.filter("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Near copies would make all their words look telling: one row for each least shingle.
    found = texts.join(F.broadcast(sample), "id").select("id", "grade", "text").mapInArrow(
        _with_least, "id bigint, grade int, least bigint, text string")
    found = save_and_reload(found, "sample")
    first = found.groupBy("least").agg(F.min("id").alias("id"))
    chosen = found.join(F.broadcast(first), ["least", "id"]).dropDuplicates(["id"])
    chosen = save_and_reload(chosen, "sample")
    sizes = {r["grade"]: r["n"] for r in chosen.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return nothing
    told = np.zeros(1 << WORD_BITS, dtype=bool)
    told[[r["feature"] for r in _telling(chosen, sizes, n_grades).collect()]] = True
    rows = chosen.mapInArrow(
        _sparse_rows(told), "id bigint, grade int, features binary, values binary").toArrow().sort_by("id")
    grade = rows.column("grade").to_numpy().astype(np.int64)
    lengths = [len(x) // 4 for x in rows.column("features").to_pylist()]
    features = np.frombuffer(b"".join(rows.column("features").to_pylist()), dtype="<i4")
    values = np.frombuffer(b"".join(rows.column("values").to_pylist()), dtype="<f4")
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    held = np.arange(len(grade)) % 5 == 4
    train = ~np.repeat(held, lengths)
    inner = np.concatenate([[0], np.cumsum(np.asarray(lengths)[~held])])
    if len(np.unique(grade[~held])) < 2:
        return nothing
    model = fit(inner, features[train], values[train], grade[~held], n_grades)
    tail = model.tails(_scores(model.weights, bounds, features, values))[:, accept_grade - 1]
    model.accept = _calibrated(tail[held], grade[held] >= accept_grade)
    return model


def _with_least(batches):
    for batch in batches:
        least = [int(x[0]) >> 1 if len(x) else 0 for x in shingle_sets(batch.column(2), 5)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(least, type=pa.int64()), batch.column(2)],
            names=["id", "grade", "least", "text"])


def _telling(rows: DataFrame, sizes: dict[int, int], n_grades: int) -> DataFrame:
    """(feature): word features that go with lower grades, by chi-squared of each cut between grades.

    Words that go with higher grades are left out: a long text has many, and they would
    outweigh the few that make it poor. At most 2^WORD_BITS rows.
    """

    def run(batches):
        for batch in batches:
            grade = batch.column("grade").to_numpy()
            for part in slices(batch.column("text")):
                bounds, features, _ = text_features(part)
                owner = np.repeat(grade[part.first : part.first + part.rows], np.diff(bounds))
                words = features < 1 << WORD_BITS
                key, n = np.unique(features[words].astype(np.int64) * n_grades + owner[words], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key // n_grades).astype(np.int32)), pa.array((key % n_grades).astype(np.int32)),
                     pa.array(n.astype(np.int64))], names=["feature", "grade", "n"])

    counts = rows.select("grade", "text").mapInArrow(run, "feature int, grade int, n bigint")
    counts = counts.groupBy("feature").agg(
        F.sum("n").alias("seen"),
        *[F.sum(F.when(F.col("grade") >= k, F.col("n")).otherwise(0)).alias(f"above{k}") for k in range(1, n_grades)])
    all_rows = sum(sizes.values())
    telling = F.lit(False)
    for k in range(1, n_grades):
        share = sum(n for g, n in sizes.items() if g >= k) / all_rows
        if 0 < share < 1:
            lack = F.greatest(F.col("seen") * share - F.col(f"above{k}"), F.lit(0.0))
            spread = F.col("seen") * (all_rows - F.col("seen")) * (share * (1 - share) / all_rows)
            telling = telling | (lack * lack >= LEAST_CHI2 * F.greatest(spread, F.lit(1e-9)))
    return counts.filter((F.col("seen") >= LEAST_SEEN) & telling).select("feature")


def _sparse_rows(told: np.ndarray):
    def run(batches):
        for batch in batches:
            features, values = [], []
            for part in slices(batch.column("text")):
                bounds, own, value = text_features(part, told)
                features += [own[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                values += [value[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("grade"), pa.array(features, type=pa.binary()),
                 pa.array(values, type=pa.binary())], names=["id", "grade", "features", "values"])

    return run


def grade_documents(docs: DataFrame, model: OrdinalModel, *, accept_grade: int, text_col: str = "text") -> DataFrame:
    """``docs`` with expected_grade, tail_probability and accepted."""
    added = ("expected_grade", "tail_probability", "accepted")
    docs = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)
    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(added, ("double", "double", "boolean")):
        schema = schema.add(name, kind)

    def run(batches):
        fitted = shared.value
        wanted = fitted.weights[: 1 << WORD_BITS] != 0
        for batch in batches:
            scores = [np.zeros(0)]
            for part in slices(batch.column(at)):
                scores.append(_scores(fitted.weights, *text_features(part, wanted)))
            tails = fitted.tails(np.concatenate(scores))
            tail = tails[:, accept_grade - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tails.sum(1)), pa.array(tail), pa.array(tail >= fitted.accept)],
                names=[*names, *added])

    return docs.mapInArrow(run, schema)


def label_grades(labels: DataFrame) -> DataFrame:
    """Graded ratings of the labels table: 0 poor, 1 fair prose but toxic, 2 fit to keep."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    return labels.select("doc_id", grade.alias("grade"))
