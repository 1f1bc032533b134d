"""Words of Arrow text columns as numpy arrays, without a Python string per word.

A word is a run of bytes other than space and \\x09-\\x0D. Texts are taken whole;
only the number of documents handled at once is limited, by their total bytes.
A word's identity is a 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_LOWER = _VALUES.copy()
_LOWER[65:91] = _VALUES[97:123]


def _powers(base: int, n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), wrapping; grown as longer texts come."""
    got = kept.get(base)
    if got is None or len(got) < n:
        size = max(n, SLICE_BYTES + 4096)
        steps = np.full(size, _U(base), dtype=_U)
        steps[0] = _U(1)
        got = np.multiply.accumulate(steps)
        if size <= 4 * SLICE_BYTES:
            kept[base] = got
    return got[:n]


@dataclass
class Slice:
    """Consecutive rows of a batch: their bytes, and where words begin and end."""

    first: int  # row of the batch
    rows: int
    data: np.ndarray  # uint8
    bounds: np.ndarray  # rows + 1 byte offsets
    starts: np.ndarray  # of words
    ends: np.ndarray
    word_bounds: np.ndarray  # rows + 1 offsets into starts

    def span_hasher(self, lower: bool = False):
        """A function from (starts, ends) to a 64-bit hash of each span; ``lower`` takes A-Z as a-z."""
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((_LOWER if lower else _VALUES)[self.data] * _powers(_BASE, n), out=sums[1:])
        back = _powers(_BASE_INVERSE, n + 1)

        def hashed(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(_U))

        return hashed

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self.span_hasher(lower)(self.starts, self.ends)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, bounds.astype(np.int64)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a column into runs of whole texts of about ``most`` bytes together."""
    raw, bounds = _buffers(column)
    rows, at = len(bounds) - 1, 0
    while at < rows:
        to = int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1
        to = min(rows, max(to, at + 1))
        data = raw[bounds[at] : bounds[to]]
        own = bounds[at : to + 1] - bounds[at]
        space = _SPACE[data]
        # A text's first byte follows a break and its last one precedes one.
        before = np.empty(len(data) + 1, dtype=bool)
        before[0] = True
        before[1:] = space
        before[own] = True
        after = np.empty(len(data) + 1, dtype=bool)
        after[:-1] = space
        after[-1] = True
        after[own] = True
        word = ~space
        starts = np.flatnonzero(word & before[:-1])
        ends = np.flatnonzero(word & after[1:]) + 1
        yield Slice(at, to - at, data, own, starts, ends, np.searchsorted(starts, own, side="left"))
        at = to
