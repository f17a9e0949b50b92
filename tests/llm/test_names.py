"""Extra columns keep their values, whatever they are called."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from chatprep.llm import mixing, quality, suffix_tree

SMALL = "/root/testdata/sf0.001"
NAMES = [
    "score", "predicted", "held_out", "size", "source_size", "target", "copies", "taken", "n_lines", "n_shared", "n_removed",
    "upto", "_full", "_h", "_source", "weight", "budget", "rest", "away", "_row", "key", "value", "_id", "_hash", "_copy", "n_tokens", "label", "id", "h",
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def extra(df, names=NAMES):
    return df.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in names})


def kept(df, names):
    rows = df.select("doc_id", *names).collect()
    return bool(rows) and all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in names)


@pytest.mark.parametrize("number", range(4))
def test_stages(spark, documents, number):
    docs = extra(documents)
    out = pipeline.STAGES[number][1](spark, docs, SMALL)
    assert out.columns == docs.columns and kept(out, NAMES)


def test_mixture(documents):
    names = [n for n in NAMES if n not in ("size", "source_size", "target", "copies", "taken")]
    out = mixing.mix(extra(documents))
    assert kept(out, names)
    plain = {tuple(r) for r in mixing.mix(documents).select("doc_id", "size", "target", "copies", "taken").collect()}
    assert {tuple(r) for r in out.select("doc_id", "size", "target", "copies", "taken").collect()} == plain


def test_suffix_tree(documents):
    names = [n for n in NAMES if n not in ("score", "n_tokens")]
    few = documents.filter("doc_id < 40")
    assert kept(suffix_tree.scores(extra(few), few), names)


def test_labels_that_are_neither(spark, documents):
    """A label of 2 counts against quality and changes nothing for the others."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = labels.withColumn("quality", F.when((F.col("quality") == 0) & (F.col("doc_id") % 2 == 0), 2).otherwise(F.col("quality")))
    want = {(r["doc_id"], r["predicted"]) for r in quality.judged(documents, labels).collect()}
    assert {(r["doc_id"], r["predicted"]) for r in quality.judged(documents, odd).collect()} == want
