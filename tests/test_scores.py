import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatprep.operators import scores as G

SCHEMA = "ctx_id long, token_id long, score double"


def _scores(seed=0, hot=400):
    """Context 0 holds most candidates, half of them tied; the others are small."""
    rng = random.Random(seed)
    rows = [(0, t, 5.0 if t % 2 else round(rng.uniform(-5, 9), 2)) for t in range(hot)]
    rows += [(c, t, float(rng.randint(-3, 3))) for c in range(1, 30) for t in range(rng.randint(1, 9))]
    return rows


def _by_context(rows):
    out = {}
    for c, t, s in rows:
        out.setdefault(c, {})[t] = s
    return out


@pytest.mark.parametrize("k", [1, 3, 50, 1000, None, 0])
def test_topk_keeps_ties(spark, k):
    rows = _scores()
    got = G.topk_filter(spark.createDataFrame(rows, SCHEMA).repartition(5), k).collect()
    want = set()
    for c, tokens in _by_context(rows).items():
        kth = sorted(tokens.values(), reverse=True)[min(k, len(tokens)) - 1] if k else -math.inf
        want |= {(c, t) for t, s in tokens.items() if s >= kth}
    assert {(r["ctx_id"], r["token_id"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("temperature", [0.1, 1.0, 2.0])
def test_softmax(spark, temperature):
    rows = [*_scores(), (100, 0, 9000.0), (100, 1, 9001.0), (101, 0, -9000.0), (102, 0, -math.inf), (102, 1, 1.0), (103, 0, 800.0), (103, 1, -800.0)]
    got = {(r["ctx_id"], r["token_id"]): r["prob"] for r in G.softmax(spark.createDataFrame(rows, SCHEMA), temperature).collect()}
    for c, tokens in _by_context(rows).items():
        top = max(tokens.values())
        e = {t: math.exp((s - top) / temperature) for t, s in tokens.items()}
        for t, x in e.items():
            assert math.isclose(got[c, t], x / sum(e.values()), rel_tol=1e-9, abs_tol=1e-300)
        assert math.isclose(sum(got[c, t] for t in tokens), 1.0, rel_tol=1e-9)


@pytest.mark.parametrize("p", [0.1, 0.5, 0.9, 1.1])
def test_nucleus(spark, p):
    probs = G.softmax(spark.createDataFrame(_scores(hot=300), SCHEMA), 2.0)
    rows = probs.collect()
    got = {(r["ctx_id"], r["token_id"]) for r in G.nucleus_filter(probs, p).collect()}
    by_context = {}
    for r in rows:
        by_context.setdefault(r["ctx_id"], []).append((-r["prob"], r["token_id"]))
    want = set()
    for c, tokens in by_context.items():
        mass = 0.0
        for falling, t in sorted(tokens):
            if mass >= p - 1e-12:
                break
            want.add((c, t))
            mass -= falling
    assert got == want


def test_draws_follow_the_probabilities(spark):
    """One context per draw, all with the same three scores."""
    n = 6000
    scores = spark.range(n).select(
        F.col("id").alias("ctx_id"), F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("token_id"), F.lit(s).alias("score")) for t, s in ((0, 0.0), (1, 1.0), (2, 2.0))])).alias("s")
    ).select("ctx_id", "s.*")
    drawn = G.sample_scores(scores, 7).collect()
    assert len(drawn) == n
    z = sum(math.exp(s) for s in (0, 1, 2))
    counts = Counter(r["token_id"] for r in drawn)
    for t in (0, 1, 2):
        expected = n * math.exp(t) / z
        assert abs(counts[t] - expected) < 5 * math.sqrt(expected)
    again = G.sample_one(G.softmax(scores), 7).collect()
    assert {tuple(r) for r in drawn} == {tuple(r) for r in again}
    assert {tuple(r) for r in drawn} != {tuple(r) for r in G.sample_scores(scores, 8).collect()}


def test_certain_and_impossible_candidates(spark):
    probs = spark.createDataFrame([(1, 5, 1.0), (1, 6, 0.0), (2, 7, 1.0)], "ctx_id long, token_id long, prob double")
    assert {tuple(r) for r in G.sample_one(probs, 1).collect()} == {(1, 5), (2, 7)}
    assert {(r[0], r[1]) for r in G.nucleus_filter(probs).collect()} == {(1, 5), (2, 7)}


@pytest.mark.parametrize("slice_rows", [7, 100])
def test_slices_change_nothing(spark, slice_rows):
    """Large contexts in many slices, cut and joined again, or all in one."""
    rows = _scores(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for k in (1, 6, 150, 1500):
        want = {tuple(r) for r in G.topk_filter(df, k).collect()}
        assert {tuple(r) for r in G.topk_filter(df, k, slice_rows=slice_rows).collect()} == want
    probs = {(r[0], r[1]): r["prob"] for r in G.softmax(df, 2.0).collect()}
    sliced = {(r[0], r[1]): r["prob"] for r in G.softmax(df, 2.0, slice_rows=slice_rows).collect()}
    assert probs.keys() == sliced.keys() and all(math.isclose(probs[x], sliced[x], rel_tol=1e-12) for x in probs)
    table = spark.createDataFrame([(*x, p) for x, p in probs.items()], "ctx_id long, token_id long, prob double")
    want = {tuple(r) for r in G.nucleus_filter(table, 0.8).collect()}
    assert {tuple(r) for r in G.nucleus_filter(table, 0.8, slice_rows=slice_rows).collect()} == want


def test_a_hot_context_spreads_evenly_and_small_ones_are_not_copied(spark):
    hot = spark.range(30_000).selectExpr("0L as ctx_id", "id as token_id", "1.0 as score")
    small = spark.range(60_000).selectExpr("id div 6 + 1 as ctx_id", "id as token_id", "1.0 as score")
    rows = hot.unionByName(small)
    slices = G.Slices(rows, "ctx_id", 1000)
    sizes = {r["_slice"]: r["n"] for r in slices.cut(rows, "token_id").filter("ctx_id = 0").groupBy("_slice").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) == 30 and max(sizes.values()) < 1300
    assert slices.large and len(slices.large) == 1
    facts = rows.select("ctx_id").distinct()
    copies = slices.meet(slices.cut(facts.withColumn("token_id", F.lit(1)), "token_id"), facts)
    assert copies.count() == facts.count()


@pytest.mark.parametrize("p", [0.05, 0.5, 0.9, 1.0])
def test_nucleus_of_many_equal_and_nearly_equal_probabilities(spark, p):
    """Masses are eighths and smaller powers of two, so that sums are exact; tokens are far apart and negative."""
    rng = random.Random(5)
    rows = []
    for c in range(12):
        parts = [1.0]
        while len(parts) < 40 and rng.random() < 0.97:
            x = parts.pop(rng.randrange(len(parts)))
            parts += [x / 2, x / 2]
        tokens = rng.sample(range(-(10**12), 10**12), len(parts))
        rows += [(c, t, x) for t, x in zip(tokens, parts)]
    rows += [(50, 1, math.nextafter(0.25, 1)), (50, 2, 0.25), (50, 3, math.nextafter(0.25, 0)), (50, 4, 0.0), (51, 9, 5e-324), (51, 8, 1e-310), (52, 3, 1.0)]
    want = set()
    for c in {r[0] for r in rows}:
        mass = 0.0
        for falling, t in sorted((-x, t) for k, t, x in rows if k == c and x > 0):
            if mass >= p:
                break
            want.add((c, t))
            mass -= falling
    df = spark.createDataFrame(rows, "ctx_id long, token_id long, prob double").repartition(4)
    got = G.nucleus_filter(df, p)
    assert {(r["ctx_id"], r["token_id"]) for r in got.collect()} == want
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString().lower()
