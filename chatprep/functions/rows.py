"""Rows out of arrays, each array computed once.

From a plain explode Spark infers a filter on the array's size and pushes it, with all the
expressions the array comes from, below: parsing or splitting a text would run twice or
more. The outer forms leave the array alone, and a filter on what they produce cannot be
pushed below them. The same holds the filter of `settled` columns in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, kept: list, array, pos: str, one: str) -> DataFrame:
    """`kept` columns, position and element, one row per element."""
    return df.select(*kept, F.posexplode_outer(array).alias(pos, one)).filter(F.col(pos).isNotNull())


def each_value(df: DataFrame, kept: list, array, one: str) -> DataFrame:
    """`kept` columns and element, one row per element that is not null."""
    return df.select(*kept, F.explode_outer(array).alias(one)).filter(F.col(one).isNotNull())


def settled(df: DataFrame, kept: list, *columns: Column) -> DataFrame:
    """`kept` and computed columns, computed before any filter that follows."""
    return df.select(*kept, F.inline_outer(F.array(F.struct(*columns))))
