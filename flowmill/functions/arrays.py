"""Array and byte expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_INTS = "array<int>"


def no_ints() -> Column:
    return F.array().cast(EMPTY_INTS)


def repeat_int(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value).cast("int"), n.cast("int"))


def pad_to(arr: Column, length: int, value: int) -> Column:
    """Right-pad to ``length``; a longer array is cut. ``arr`` is evaluated once."""
    return F.slice(F.concat(arr, F.array_repeat(F.lit(value).cast("int"), length)), 1, length)


def frame_with(arr: Column, length: int, head: int, tail: int, pad: int) -> Column:
    """``head`` + the first ``length - 2`` items + ``tail``, padded to ``length``."""
    body = F.slice(arr, 1, length - 2)
    framed = F.concat(
        F.array(F.lit(head).cast("int")), body, F.array(F.lit(tail).cast("int"))
    )
    return pad_to(framed, length, pad)


def indexes(n: Column) -> Column:
    """[0 .. n-1]; empty when n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(no_ints())


def hex_tokens(data: Column) -> Column:
    """Binary -> array of two-digit lower-case hex strings, one per byte."""
    return F.regexp_extract_all(F.lower(F.hex(data)), F.lit(".."), F.lit(0))


def byte_values(data: Column) -> Column:
    """Binary -> array of ints 0..255 (Latin-1 maps each byte to its code point)."""
    text = F.decode(data, "ISO-8859-1")
    return F.when(
        F.octet_length(data) > 0, F.transform(F.split(text, ""), lambda c: F.ascii(c))
    ).otherwise(no_ints())


def big_endian(data: Column, offset, nbytes: int) -> Column:
    """Unsigned big-endian integer at a 0-based byte offset of a binary."""
    start = (offset if isinstance(offset, Column) else F.lit(offset)) + 1
    return F.conv(F.hex(F.substring(data, start, F.lit(nbytes))), 16, 10).cast("bigint")


def hex_fixed(value: Column, digits: int) -> Column:
    """Non-negative integer as ``digits`` hex digits (big-endian when unhexed)."""
    return F.lpad(F.hex(value.cast("bigint")), digits, "0")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def log_sum_exp(a: Column) -> Column:
    """Stable log of the sum of exponentials of an array."""
    top = F.array_max(a)
    return top + F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def joined(a: Column, sep: str = " ") -> Column:
    return F.array_join(a.cast("array<string>"), sep)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    A column named inside a lambda may be inlined there and computed again for
    every element; binding it as a lambda argument keeps it computed once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
