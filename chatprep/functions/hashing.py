"""Reproducible pseudo-randomness from md5, the same on every engine and every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MANTISSA_DIGITS = 13  # 13 hex digits = 52 bits, exact in a double


def seeded_hash(seed, *keys: Column) -> Column:
    """md5 of `seed:key:key...` as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hex_prefix(h: Column, start: int, digits: int) -> Column:
    """`digits` hex digits from position `start` (1-based) as a number."""
    return F.conv(F.substring(h, start, digits), 16, 10).cast("bigint")


def uniform(h: Column) -> Column:
    """A number in (0, 1) from a hex hash."""
    return (hex_prefix(h, 1, _MANTISSA_DIGITS) + F.lit(0.5)) / F.lit(float(16**_MANTISSA_DIGITS))
