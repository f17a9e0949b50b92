"""Column functions on text: stripping, cleaning, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatprep.constants import WHITESPACE


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends (`trim` alone knows only the blank)."""
    return F.btrim(col, F.lit(WHITESPACE))


def clean(col: Column) -> Column:
    """Strip, drop enclosing double then single quotes, strip again."""
    return strip(clean_keep_inner_space(col))


def clean_keep_inner_space(col: Column) -> Column:
    """`clean` without the last strip: what template-driven chat applies to a message."""
    return F.btrim(F.btrim(strip(col), F.lit('"')), F.lit("'"))


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def excerpt(col: Column, width: int, marker: str = "...") -> Column:
    """First `width` characters, followed by `marker` only where something was cut."""
    head = F.substring(col, 1, width)
    return F.when(F.length(col) > width, F.concat(head, F.lit(marker))).otherwise(head)


def escape_tilde(col: Column) -> Column:
    return F.replace(col, F.lit("~"), F.lit("\\~"))


def join_lines(*cols: Column) -> Column:
    """Newline-joined, skipping sides that are null."""
    return F.concat_ws("\n", *cols)
