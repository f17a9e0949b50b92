import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from chatprep.llm import collocations as C
from chatprep.sources.shared import arrow_rows

SCHEMA = "doc_id long, lang string, text string, n string, words string, s1 string, rank string"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute(rows, min_count, max_words, top, share=100):
    f, n = defaultdict(Counter), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in f.items():
        known = {p: a for p, a in found.items() if a >= min_count}
        inside = {p[i : i + k] for p, b in known.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * b >= share * known[p[i : i + k]]}
        rated = []
        for p, a in known.items():
            if len(p) > 1 and p not in inside:
                score, k = min((1000 * a * n[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(rated)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(rng):
    """Few words, so that many phrases come again; one language holds most, one phrase a third of it."""
    words = [f"w{i}" for i in range(30)] + ["Äpfel", "THE", "|", "x" * 100]
    weights = [40 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", "en", "de", None, "und", ""])
        text = "".join(rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", ", "]) + w for w in rng.choices(words, weights, k=rng.randint(0, 60)))
        rows.append((i, lang, text + " hot phrase of many words here" * rng.choice([0, 0, 5])))
    rows += [(900, "en", None), (901, "en", ""), (902, "en", "!!.\n"), rows[3], rows[3], (903, "long", "a b c, b a " * 130_000), (904, "en", "y" * 3_000_000 + " w0 w1")]
    return rows


@pytest.mark.parametrize("held, group_rows", [(C.HELD_WORDS, C.GROUP_ROWS), (5, 10), (1000, 400)])
def test_against_brute_force(spark, held, group_rows):
    """Words with and without a rank, groups of a few suffixes, texts and words of over a megabyte."""
    rows = corpus(random.Random(7))
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(5)
    got = C.collocations(df, min_count=8, top=50, held=held, group_rows=group_rows)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 8, 5, 50)


@pytest.mark.parametrize("max_words, share", [(2, 100), (3, 60)])
def test_lengths_and_shares(spark, max_words, share):
    rows = corpus(random.Random(8))[:260]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    got = C.collocations(df, min_count=5, max_words=max_words, top=10_000, share=share)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, max_words, 10_000, share)


def test_products_beyond_64_bits(spark):
    a, n, left, right = 10**15 + 7, 10**17 + 9, 3 * 10**15 + 1, 10**16 + 3
    phrases = spark.createDataFrame([(1, 2, 2, a)], "s1 long, s2 long, length int, n long")
    words = spark.createDataFrame([("en", 1, left), ("en", 2, right)], "lang string, symbol long, n long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    row = C.scored(phrases, words, totals, 2, 1).first()
    assert row["score"] == 1000 * a * n // (left * right) and (row["l"], row["r"]) == (left, right)


def test_no_rows(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(spark.createDataFrame([(1, "en", "too few words", "", "", "", "")], SCHEMA)).collect() == []


def test_memory_of_encoded_texts(spark):
    """A symbol takes the bytes it needs, and batches to Python hold few rows, whatever their size."""
    texts = spark.createDataFrame([("en", "a b c d " * 50_000)] * 3, "lang string, text string").repartition(1)
    rows = C.encoded(texts, {"en": {w: i + 1 for i, w in enumerate([b"a", b"b", b"c", b"d"])}}, False, 5).collect()
    assert sum(len(r["ids"]) for r in rows) < 2 * 600_000

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with arrow_rows(spark, 256):
        assert spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] <= 256
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_rows_of_encoded_texts_stay_small(spark):
    """Where frequent words have no rank, rare ones are left out all the same, and the others alone take eight bytes."""
    rng = random.Random(3)
    common, rare = [f"w{i}" for i in range(40)], [f"rare{i}" for i in range(2000)]
    said = [rng.choices([*common, rng.choice(rare)], [40 / (i + 1) for i in range(41)])[0] for _ in range(100_000)]
    texts = spark.createDataFrame([("en", " ".join(said))], "lang string, text string")
    _, ranks, others = C.symbols(C.word_counts(texts), 100, held=20)
    assert len(ranks["en"]) == 20 and others
    rows = C.encoded(texts, ranks, others, 5).collect()
    ids = np.concatenate([C.unpacked(r["ids"], 1)[0][: r["own"]] for r in rows])
    counts = Counter(said)
    unranked = {C.word_symbol("en", w.encode()) for w, n in counts.items() if n >= 100 and w.encode() not in ranks["en"]}
    taken = set(ids[ids < 0].tolist())
    assert unranked <= taken and len(taken - unranked) < len(rare) // 4
    assert max(len(r["ids"]) for r in rows) < 1 << 15
    assert sum(len(r["ids"]) for r in rows) < 4 * len(said)


@pytest.mark.parametrize("share", [0, 0.02, 0.5, 1])
def test_packed_numbers(share):
    rng = np.random.default_rng(5)
    column = rng.integers(0, 1 << 18, 5000)
    apart = rng.random(5000) < share
    column[apart] = rng.integers(-(1 << 62), 0, apart.sum())
    ends = np.array([np.iinfo(np.int64).max, 0, np.iinfo(np.int64).min])
    got = C.unpacked(C.packed([column, column // 7]), 2)
    assert (got[0] == column).all() and (got[1] == column // 7).all()
    assert (C.unpacked(C.packed([ends]), 1)[0] == ends).all()
    assert share > 0.02 or len(C.packed([column])) < 4 * 5000
