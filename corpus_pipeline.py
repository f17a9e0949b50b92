"""A corpus from raw documents to token ids: judged, cleaned, deduplicated, mixed and encoded.

Each stage takes the session, the documents that the stage before kept, and the folder of
the tables, and returns a DataFrame; `run` writes it as Parquet to the shared folder and
reads it again as the next one's documents. All stages but the last return the columns of
the documents they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.llm import line_dedup, mixing, near_copies, quality, sentencepiece_sampling
from chatprep.llm.frames import put_back, set_apart
from chatprep.sources.shared import stored

SAMPLES = 2
# Training a classifier and drawing segmentations have no SQL.
ORACLE_SQL = None


def _apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage on documents whose further columns have names that no operator gives to its results."""
    used = ("doc_id", "text", "source", "lang", "n_chars")
    rows, names = set_apart(docs, *used)
    return put_back(stage(rows), names, docs.columns, [])


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the folder's labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _apart(docs, lambda rows: quality.judged(rows, labels).filter("predicted = 1"))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those with lines of their own without the lines that many sources share; `n_chars` follows the text."""

    def cleaned(rows: DataFrame) -> DataFrame:
        left = line_dedup.remove_shared_lines(rows)
        if "n_chars" not in rows.columns:
            return left
        n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        return left.withColumn("n_chars", n_chars.cast(rows.schema["n_chars"].dataType))

    return _apart(docs, cleaned)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8 or more. Texts without words are one group."""
    return _apart(docs, near_copies.keep_one)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a row for each time."""
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return _apart(docs, lambda rows: mixing.mix(rows).filter("copies > 0").withColumn("_copy", again))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids: distinct segmentations of every document, with inclusion probabilities."""
    pieces = sentencepiece_sampling.load()
    encoded = sentencepiece_sampling.encode(docs.select("doc_id", "source", "text"), pieces, SAMPLES)
    each = encoded.select("doc_id", "source", F.posexplode_outer("samples").alias("sample", "one"))
    return each.select("doc_id", "source", "sample", "one.ids", "one.log_probability", "one.inclusion")


STAGES = [("quality", judge), ("line_dedup", remove_lines), ("near_dedup", remove_copies), ("mixture", mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
