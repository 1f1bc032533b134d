"""Entropy-based reliability of encoded sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.functions.arrays import let
from flowmill.operators.encode import PAD

# Fixed values.
EPSILON = 1e-10


def flow_reliability(seq: Column, vocab_size: int) -> Column:
    """1 - H / ln(min(n, V)) of the token counts of one row, in [0, 1].

    The row's tokens are sorted and their run lengths summed in one pass, so
    nothing is exploded or shuffled.
    """
    def reliability(s):
        n = F.size(s)

        def step(acc, x):
            same = x == acc["token"]
            return F.struct(
                x.alias("token"),
                F.when(same, acc["run"] + 1).otherwise(F.lit(1)).alias("run"),
                F.when(same, acc["h"]).otherwise(acc["h"] + term(acc["run"], n)).alias("h"),
            )

        start = F.struct(
            F.lit(-1).cast("int").alias("token"), F.lit(0).cast("int").alias("run"), F.lit(0.0).alias("h")
        )
        h = F.aggregate(s, start, step, lambda acc: acc["h"] + term(acc["run"], n))
        top = F.ln(F.least(n, F.lit(vocab_size)).cast("double"))
        return F.when(
            top > 0, F.least(F.greatest(1 - h / top, F.lit(0.0)), F.lit(1.0))
        ).otherwise(F.lit(1.0))

    def term(run, n):
        p = run / n
        return F.when(run > 0, -p * F.ln(p + EPSILON)).otherwise(F.lit(0.0))

    return let(F.sort_array(F.filter(seq, lambda x: x != PAD)), reliability)


def _window_reliability(tokens: np.ndarray, half: int) -> np.ndarray:
    """Per position 1 - H/ln(n) of the window around it; rows are sequences."""
    padded = np.pad(tokens, ((0, 0), (half, half)), constant_values=PAD)
    length = tokens.shape[1]
    views = [padded[:, k:k + length] for k in range(2 * half + 1)]
    used = [v != PAD for v in views]
    n = np.sum(used, axis=0)
    logs = np.zeros(tokens.shape)
    for a, here in zip(views, used):
        count = np.sum([a == b for b in views], axis=0)
        logs += np.where(here, np.log(np.maximum(count, 1)), 0.0)
    safe = np.maximum(n, 1)
    top = np.log(safe)
    h = top - logs / safe
    value = np.where(top > 0, 1 - h / np.where(top > 0, top, 1.0), 1.0)
    return np.where(tokens == PAD, 0.0, np.clip(value, 0.0, 1.0))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _local(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for arr in batches:
        lengths = np.asarray(arr.value_lengths().fill_null(0))
        flat = np.asarray(arr.flatten())
        starts = np.concatenate([[0], np.cumsum(lengths)])
        out = np.zeros(len(flat))
        # Sequences of one length go through together, a bounded number at a time.
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            for at in range(0, len(rows), 512):
                some = rows[at:at + 512]
                index = starts[some][:, None] + np.arange(length)
                out[index] = _window_reliability(flat[index], 8)
        yield pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(out))


def local_reliability(seq: Column) -> Column:
    """Reliability of the 17-token window around each position; 0 at padding.

    Counting equal tokens in every window is quadratic in its width, which numpy
    does for a whole batch of sequences at once.
    """
    return _local(seq)
