"""Filter interaction audit by a Gray-code walk over filter subsets.

Each document is reduced to a mask: bit i is set if filter i fails it. Documents of a part
with the same mask form a cell, so a part has at most 2^k cells whatever its size. The walk
visits all 2^k subsets of filters in Gray-code order: each step switches one filter on or off,
which moves every cell's counter of active failures by at most one, and the running survivors
change only by the cells whose counter leaves or reaches zero. The survivors of every subset
are stored; what a filter removes after any others is the difference of two stored states,
so all k! orders come from 2^k states.

How it holds at scale: flags are JVM expressions on one row. Exact copies are found by one
aggregation on (text digest, part, mask, labels), which combines before its shuffle, so a group of
copies of any size is a few rows; cells are a second such aggregation, and the walk sees at
most 2^k rows a part.

Defined cases: null text is empty; null part is the empty part; a null id is never a later copy
nor an earlier one; repeated rows of one id count each, and none is a copy of the other; an id
labelled several times has a flag if any of its rows has; no documents give no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTS = ("n", "n_good", "n_toxic")
STEP_COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D on one text, true where it fails. ``text`` must not be null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    distinct = F.size(F.array_distinct(words))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": F.lit(100) * distinct < F.lit(80) * F.size(words),
        "C": F.lit(100) * capitals > F.lit(10) * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _bits(flags: list[Column]) -> Column:
    mask = F.lit(0)
    for at, failed in enumerate(flags):
        mask = mask + F.when(failed, F.lit(1 << at)).otherwise(F.lit(0))
    return mask


def failure_cells(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by the set of filters A to E that fail them.

    ``docs`` has doc_id, text and the part's column; ``labels`` has doc_id, quality and toxic.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                         text.alias("text"))
    narrow = marked.select("id", "part", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"),
                           _bits(list(text_failures(F.col("text")).values())).alias("mask"))
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int").alias(c)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(flag("quality"), flag("toxic"))
    joined = narrow.join(known, "id", "left").fillna(0, ["quality", "toxic"])
    alike = ["digest", "part", "mask", "quality", "toxic"]
    # Rows of one id first, so that the least id of a text comes with the number of its rows.
    rows = joined.groupBy("id", *alike).agg(F.count(F.lit(1)).alias("n"))
    groups = rows.groupBy(*alike).agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    # One text has few (part, labels) groups, however many copies; its least id is the least of theirs.
    groups = groups.withColumn("first_id", F.min("least.id").over(Window.partitionBy("digest")))
    own = F.when(F.col("least.id") == F.col("first_id"), F.col("least.n")).otherwise(0) + F.col("n_null")
    split = groups.select("part", "mask", "quality", "toxic", F.explode(F.array(
        F.struct(F.lit(0).alias("bit"), own.alias("n")),
        F.struct(F.lit(1 << 4).alias("bit"), (F.col("n") - own).alias("n")))).alias("x"))
    return split.filter("x.n > 0").groupBy("part", (F.col("mask") + F.col("x.bit")).alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("quality")).alias("n_good"),
        F.sum(F.col("x.n") * F.col("toxic")).alias("n_toxic"))


def gray_walk(masks: np.ndarray, counts: np.ndarray, n_filters: int) -> np.ndarray:
    """Survivors of every subset of filters: row S holds the sums of ``counts`` over cells no filter of S fails.

    ``masks`` has one bit set a failing filter; ``counts`` has a row a cell.
    """
    states = np.zeros((1 << n_filters, counts.shape[1]), dtype=np.int64)
    failures = np.zeros(len(masks), dtype=np.int64)  # active filters that fail each cell
    survivors = counts.sum(axis=0).astype(np.int64)
    subset = 0
    states[subset] = survivors
    for step in range(1, 1 << n_filters):
        bit = (step & -step).bit_length() - 1  # the filter this step toggles
        touched = (masks >> bit & 1).astype(bool)
        if subset >> bit & 1:
            failures[touched] -= 1
            survivors = survivors + counts[touched & (failures == 0)].sum(axis=0)
        else:
            survivors = survivors - counts[touched & (failures == 0)].sum(axis=0)
            failures[touched] += 1
        subset ^= 1 << bit
        states[subset] = survivors
    return states


def _steps(masks: np.ndarray, counts: np.ndarray, names: str) -> pd.DataFrame:
    """Every (order, step) of one part, from the stored states of the walk."""
    states = gray_walk(masks, counts, len(names))
    failing = [int(counts[masks >> f & 1 == 1, 0].sum()) for f in range(len(names))]
    only = [int(counts[masks == 1 << f, 0].sum()) for f in range(len(names))]
    rows = []
    shapley = [0] * len(names)
    for order in permutations(range(len(names))):
        subset = 0
        for step, f in enumerate(order, 1):
            lost = states[subset] - states[subset | 1 << f]
            subset |= 1 << f
            shapley[f] += int(lost[0])
            rows.append(("".join(names[i] for i in order), step, f, states[subset, 0], lost[0], failing[f] - lost[0],
                         only[f], lost[1], lost[2]))
    table = pd.DataFrame(rows, columns=["filter_order", "step", "f", *STEP_COLUMNS[:-1]])
    table["shapley"] = table.pop("f").map(dict(enumerate(shapley)))
    return table


def interaction_audit(cells: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row per (part, order of the filters, step).

    ``cells`` has part, mask and the counts n, n_good and n_toxic; names[i] is the filter of bit i.
    kept: documents left after the step. removed, good_lost, toxic_lost: what it takes out. redundant:
    failing the filter, gone before. unique_fails: failing it alone. shapley: its removed, summed over all orders.
    """
    if factorial(len(names)) > 10_000:
        raise ValueError("all orders are listed: at most seven filters")
    kinds = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in STEP_COLUMNS)

    def walk(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        table = _steps(cell["mask"].to_numpy(np.int64), cell[list(COUNTS)].to_numpy(np.int64), names)
        table.insert(0, "part", key[0])
        return table

    return cells.groupBy("part").applyInPandas(walk, kinds)
