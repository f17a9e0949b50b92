import random

import numpy as np
from pyspark.sql import functions as F

from chatprep.llm import toxicity as T

SF = "/root/testdata/sf0.1"
PLAIN = "the of and in to words here there more less some other thing place time".split()
BAD = ["rude", "nasty", "vile", "hateful"]


def made(n, seed):
    rng = random.Random(seed)
    texts, grades = [], []
    for _ in range(n):
        grade = rng.choice([0, 0, 0, 1, 2, 3])
        words = [rng.choice(PLAIN) for _ in range(rng.choice([5, 40]))] + rng.sample(BAD, grade)
        rng.shuffle(words)
        texts.append(" ".join(words).upper().encode() if rng.random() < 0.2 else " ".join(words).encode())
        grades.append(grade)
    return texts, np.array(grades)


def test_grades_are_learned_in_order():
    model = T.fit(*made(600, 1))
    texts, grades = made(300, 2)
    above = model.above(texts)
    assert (np.diff(model.thresholds) > 0).all() and (np.diff(above, axis=1) <= 0).all()
    found = (above >= 0.5).sum(axis=1)
    assert (found == grades).mean() > 0.95
    expected = above.sum(axis=1)
    assert all(expected[grades == k].mean() < expected[grades == k + 1].mean() for k in range(3))


def test_slope_is_the_gradient():
    rng = np.random.default_rng(0)
    n, docs = 5, 40
    doc, at, y = rng.integers(0, docs, 90), rng.integers(0, n, 90), rng.integers(0, 4, docs)
    flat = rng.standard_normal(n + 3)

    def loss(flat):
        weights, thresholds = T._unpacked(flat, n)
        line = np.bincount(doc, weights=weights[at], minlength=docs)
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        p = T._logistic(edges[y + 1] - line) - T._logistic(edges[y] - line)
        return -np.log(p).mean() + T.SHRINK * (weights**2).sum() / 2

    slope = T._slope(flat, n, doc, at, y)
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-6 - slope[i]) < 1e-6


def test_held_out_documents(spark):
    """Documents with insults are found and clean ones left alone; some labelled toxic hold no sign of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learn = F.col("doc_id") % 4 != 0
    model = T.train(docs, labels, wanted=learn)
    rows = T.with_severity(docs.filter(~learn), model).join(labels, "doc_id").select("toxic", "toxic_probability", "text").collect()
    insults = {"idiot", "scum", "moron", "loser", "trash", "stupid"}
    caught = [r["toxic_probability"] >= 0.5 for r in rows if r["toxic"] and insults & set(r["text"].split())]
    clean = [r["toxic_probability"] >= 0.5 for r in rows if not r["toxic"]]
    assert len(caught) > 20 and np.mean(caught) > 0.9 and np.mean(clean) < 0.02


def test_rows(spark):
    model = T.fit(*made(400, 3))
    rows = [(1, None, "x"), (2, "", "x"), (3, "vile nasty rude words", "x"), (3, "vile nasty rude words", "x"), (None, "words", None), (4, "words " * 50_000 + "vile", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, severity string").repartition(3)
    got = T.with_severity(df, model)
    assert got.columns == ["doc_id", "text", "severity", "grade", "toxic_probability"]
    grades = sorted((r["doc_id"] or 0, r["grade"]) for r in got.collect())
    assert grades == [(0, 0), (1, 0), (2, 0), (3, 3), (3, 3), (4, 1)]
    assert T.with_severity(df.limit(0), model).collect() == []


def test_few_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    found = T.with_severity(docs, T.train(docs, labels)).collect()
    assert all(0 <= r["toxic_probability"] <= 1 for r in found)
    same = spark.createDataFrame([(1, 0), (2, 0), (2, None)], "doc_id long, toxic int")
    assert all(r["grade"] == 0 for r in T.with_severity(docs, T.train(docs, same)).collect())
