"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TEXT_BYTES = 1 << 20


def labelled_sample(df: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, max_rows: int, max_bytes: int, wanted: Column | None = None) -> list[tuple]:
    """`(id, text bytes, label)` of at most `max_rows` labelled rows, `max_bytes` of text together, by order of a hash.

    Null ids, labels and texts are left out; of several labels of an id the largest counts.
    Texts of more than `MAX_TEXT_BYTES`, or more than `max_bytes` by themselves, are not
    learned from, so that a few long ones never make up the sample; it ends at the first row
    that would pass `max_bytes`. A label that no row of the sample has is an error.
    The hash orders rows alike at every size and partitioning.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    rows = df.filter(wanted) if wanted is not None else df
    rows = rows.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    h = F.xxhash64("id", F.lit(17))
    sized = rows.select("id", h.alias("h"), F.octet_length("text").alias("n")).join(known, "id")
    longest = min(MAX_TEXT_BYTES, max_bytes)
    picked = sized.filter(F.col("n") <= longest).orderBy("h", "id", "n").limit(max_rows).select("h", "n").collect()
    total, last = 0, None
    for row in picked:
        total += row["n"]
        if total > max_bytes:
            break
        last = row["h"]
    there = {r["label"] for r in sized.select("label").distinct().collect()}
    if last is None and not there:
        return []
    chosen = rows.filter((h <= last) & (F.octet_length("text") <= longest)).join(known, "id").select("id", F.col("text").cast("binary").alias("text"), "label")
    found = [(r["id"], bytes(r["text"]), r["label"]) for r in chosen.orderBy(h, "id", "text").limit(max_rows).collect()]
    if missing := there - {y for _, _, y in found}:
        raise ValueError(f"no training row of label {sorted(missing)} is within {max_rows} rows, {max_bytes} bytes and {longest} bytes a text")
    return found
