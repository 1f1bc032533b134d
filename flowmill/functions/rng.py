"""Counter-based random numbers.

A draw is a hash of (seed, salt, row identity), so a result does not depend on
partitioning, task retries or row order, and any SQL engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _text(x) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(str(x))


def hash_key(*parts) -> Column:
    """Hex digest ordering rows pseudo-randomly: md5 of the '|'-joined parts."""
    return F.md5(F.concat_ws("|", *[_text(p) for p in parts]))


def uniform(*parts) -> Column:
    """Uniform double in [0, 1) from 32 bits of the digest."""
    head = F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10)
    return head.cast("bigint") / F.lit(TWO_POW_32)


def uniform_open(*parts) -> Column:
    """Uniform double in (0, 1): never 0, so its logarithm is finite."""
    head = F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10)
    return (head.cast("bigint") + F.lit(0.5)) / F.lit(TWO_POW_32)
