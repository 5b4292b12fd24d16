"""Order-insensitive 64-bit row hashes in which NULL counts as 2^64-1.

A row's hash is the sum of its columns' hashes modulo 2^64, so the order of the columns does not matter and
``row_hash(a, NULL) == row_hash(a) - 1``. Hashes are the BIGINT of their 64 bits; ``unsigned`` shows them as numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF


def _wrapping_add(a: Column, b: Column) -> Column:
    """a + b modulo 2^64 on signed longs, in halves since ANSI addition raises on overflow."""
    low = a.bitwiseAND(F.lit(_LOW)) + b.bitwiseAND(F.lit(_LOW))
    high = F.shiftright(a, 32) + F.shiftright(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def _md5_prefix(c: Column) -> Column:
    """The first 15 hex digits of md5 of a value's text: 60 bits, so never negative."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")


def _each(cols: tuple[str | Column, ...], one: Callable[[Column], Column]) -> list[Column]:
    if not cols:
        raise ValueError("a row hash needs a column")
    return [F.when(c.isNull(), F.lit(-1).cast("bigint")).otherwise(one(c)) for c in (F.col(c) if isinstance(c, str) else c for c in cols)]


def row_hash(*cols: str | Column) -> Column:
    """Portable form, which any engine with md5 can repeat."""
    return reduce(_wrapping_add, _each(cols, _md5_prefix))


def fast_row_hash(*cols: str | Column) -> Column:
    """Same contract on xxhash64; stays in generated code."""
    return reduce(_wrapping_add, _each(cols, lambda c: F.xxhash64(c)))


def row_bucket(cols: list[str | Column], bits: int, portable: bool = False) -> Column:
    """``bucket(fast_row_hash(*cols), bits)``, or of ``row_hash`` if ``portable``: low bits need no 64-bit addition."""
    each = _each(tuple(cols), _md5_prefix if portable else lambda c: F.xxhash64(c))
    return bucket(reduce(lambda a, b: a + b, (h.bitwiseAND(F.lit(_mask(bits))) for h in each)), bits)


def unsigned(h: Column) -> Column:
    """The hash as a DECIMAL(20,0) in [0, 2^64)."""
    return h.cast("decimal(20,0)") + F.when(h < 0, F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(F.lit("0").cast("decimal(20,0)"))


def _mask(bits: int) -> int:
    if not 0 < bits < 31:
        raise ValueError("bits must lie in 1..30")
    return 2**bits - 1


def bucket(h: Column, bits: int) -> Column:
    """The low ``bits`` bits of a hash, as INT."""
    return h.bitwiseAND(F.lit(_mask(bits))).cast("int")
