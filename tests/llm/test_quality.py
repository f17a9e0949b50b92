import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatprep.llm import hashed, quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    judged = Q.judged(docs.withColumn("score", F.lit("clash")), labels)
    rows = judged.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    for quality in (0, 1):
        mine = [r["predicted"] == quality for r in held if r["quality"] == quality]
        assert len(mine) > 10 and np.mean(mine) > 0.9


def test_scores_depend_on_the_text_alone(spark):
    model = Q.fit([b"good words here", b"bad bad !!! ###"] * 20, [1, 0] * 20)
    rows = [(1, "good words", "en", 3), (2, None, None, None), (3, "", "en", 0), (None, "good words", "de", 3), (1, "good words", "en", 3), (4, "bad !!! " * 50_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, predicted int").repartition(4)
    got = {(r["doc_id"], r["text"] and r["text"][:10]): r["score"] for r in Q.with_scores(df, model).collect()}
    assert got[1, "good words"] == got[None, "good words"] > 0.5 > got[4, "bad !!! ba"]
    assert got[2, None] == got[3, ""] and 0 < got[2, None] < 1
    assert Q.with_scores(df.limit(0), model).collect() == []


def test_labels_of_held_out_rows_do_not_count(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("quality", F.when(Q.learnable(), F.col("quality")).otherwise(1 - F.col("quality")))
    scores = [sorted(tuple(r) for r in Q.judged(docs, ls).select("doc_id", "score").collect()) for ls in (labels, other)]
    assert scores[0] == scores[1]


def test_few_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in Q.judged(docs, none).collect()] == [0.5] * 3
    for label in (0, 1):
        same = spark.createDataFrame([(i, label) for i in range(9)] + [(1, None), (None, 0)], "doc_id long, quality int")
        assert {r["predicted"] for r in Q.judged(docs, same).collect()} == {label}


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(i, "w " * i) for i in range(200)], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i % 200, i % 2) for i in range(300)], "doc_id long, quality int")
    from chatprep.llm.sampling import labelled_sample

    few = labelled_sample(docs, labels, "quality", "doc_id", "text", 40, 1 << 20)
    assert len(few) == 40 == len({r[0] for r in few}) and few == labelled_sample(docs.coalesce(1), labels, "quality", "doc_id", "text", 40, 1 << 20)
    small = labelled_sample(docs, labels, "quality", "doc_id", "text", 40, 2000)
    assert small == few[: len(small)] and 0 < sum(len(r[1]) for r in small) <= 2000


def test_long_texts_do_not_make_up_the_sample(spark, monkeypatch):
    from chatprep.llm import sampling as L

    monkeypatch.setattr(L, "MAX_TEXT_BYTES", 100)
    docs = spark.createDataFrame([(i, "w " * (900 if i % 3 == 0 else 10)) for i in range(90)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    found = L.labelled_sample(docs, labels, "quality", "doc_id", "text", 90, 2000)
    assert len(found) == 60 and {y for _, _, y in found} == {0, 1} and all(i % 3 for i, _, _ in found)
    with pytest.raises(ValueError, match=r"label \[1\]"):
        L.labelled_sample(docs, labels.withColumn("quality", (labels.doc_id % 3 == 0).cast("int")), "quality", "doc_id", "text", 90, 2000)


def test_hashed_spans():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(rng.choice([0, 1, 40]))).encode() for _ in range(30)]
    for limit in (64, 1 << 20):
        words, grams = {}, {}
        for chunk in hashed.chunks(texts, limit):
            h = chunk.word_hashes()
            for x, a, b in zip(h.tolist(), chunk.starts, chunk.ends):
                assert words.setdefault(chunk.data[a:b].tobytes(), x) == x
            g, doc = chunk.grams(3)
            for d in doc.tolist():
                grams[d] = grams.get(d, 0) + 1
        assert set(words) == {w for t in texts for w in t.split()} and len(set(words.values())) == len(words)
        assert grams == {d: n for d, t in enumerate(texts) if (n := sum(len(w) for w in t.split()))}
