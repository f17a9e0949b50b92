import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from chatprep.llm import sentencepiece_sampling as S


@pytest.fixture(scope="module")
def pieces():
    return S.load()


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL)


def all_ways(pieces, processor, text, alpha=1.0):
    """Log probability of every segmentation."""
    names = {processor.id_to_piece(i): i for i in range(processor.get_piece_size()) if np.isfinite(pieces.weight[i])}
    found = {}

    def go(at, ids, log):
        if at == len(text):
            found[tuple(ids)] = log
            return
        for to in range(at + 1, min(len(text), at + 16) + 1):
            if text[at:to] in names:
                i = names[text[at:to]]
                go(to, [*ids, i], log + alpha * pieces.weight[i])
        if text[at] not in names:
            go(at + 1, [*ids, *(processor.piece_to_id(f"<0x{b:02X}>") for b in text[at].encode())], log + alpha * pieces.unknown)

    go(0, [], 0.0)
    total = np.logaddexp.reduce(list(found.values()))
    return {ids: log - total for ids, log in found.items()}


@pytest.mark.parametrize(("text", "alpha"), [("ab the", 1.0), ("in  the", 0.3), ("a\né𝕏", 0.2)])
def test_samples_follow_the_law_of_draws_without_replacement(pieces, processor, text, alpha):
    plain, n, k = pieces.normalized([text])[0], 6000, 3
    ways = all_ways(pieces, processor, plain, alpha)
    seeds = np.arange(n, dtype=np.uint64) * np.uint64(7919) + np.uint64(3)
    drawn = [[(tuple(s[0].tolist()), s[1], s[2]) for s in row] for row in S.segmentations(pieces, [plain] * n, seeds, k, alpha)]
    assert all(len({ids for ids, _, _ in row}) == min(k, len(ways)) for row in drawn)
    assert all(abs(ways[ids] - log) < 1e-9 for row in drawn[:500] for ids, log, _ in row)
    p = {ids: math.exp(log) for ids, log in ways.items()}
    for length in (1, 2, 3):
        seen = Counter(tuple(ids for ids, _, _ in row[:length]) for row in drawn)
        for order, count in seen.most_common(4):
            want, left = 1.0, 1.0
            for ids in order:
                want, left = want * p[ids] / left, left - p[ids]
            assert abs(count / n - want) < 5 * math.sqrt(want / n) + 1e-3
    # Inclusion probabilities make weighted sums unbiased: here, of the whole mass.
    assert abs(np.mean([sum(math.exp(log) / inclusion for _, log, inclusion in row) for row in drawn]) - 1) < 0.02


def test_all_segmentations_of_a_short_text(pieces, processor):
    plain = pieces.normalized(["ab"])[0]
    [row] = S.segmentations(pieces, [plain], np.array([1], np.uint64), 100, 1.0)
    assert {tuple(ids.tolist()) for ids, _, _ in row} == set(all_ways(pieces, processor, plain))
    assert all(inclusion == 1.0 for _, _, inclusion in row) and abs(sum(math.exp(log) for _, log, _ in row) - 1) < 1e-9


ROWS = [
    (1, "The cat sat.\nOn the mat\t日本 𝕏 é", "c"), (2, None, "c"), (3, "", "c"), (4, "  two  blanks ", None), (5, "x" * 3000, "c"),
    (6, "many words of a long text " * 8000, "c"), (1, "The cat sat.\nOn the mat\t日本 𝕏 é", "d"), (None, "no id", "c"), (None, "no id either", "c"),
]
SCHEMA = "doc_id long, text string, samples string"


def test_round_trips(spark, pieces, processor):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = S.encode(df.repartition(4), pieces, 2)
    assert got.columns == ["doc_id", "text", "samples"]
    rows = got.collect()
    for r in rows:
        if r["text"] is None:
            assert r["samples"] is None
            continue
        found = [s["ids"] for s in r["samples"]]
        assert len(found) == (1 if r["text"] == "" else 2) and len({tuple(ids) for ids in found}) == len(found)
        assert all(processor.decode(ids) == r["text"] for ids in found)
        assert all(s["log_probability"] <= 0 and 0 <= s["inclusion"] <= 1 for s in r["samples"])
    again = S.encode(df.coalesce(1), pieces, 2).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert S.encode(df.limit(0), pieces).collect() == []
    each = got.select("text", F.explode("samples").alias("s")).select("text", "s.ids")
    assert S.decode(each, pieces).filter("decoded <> text OR decoded IS NULL").count() == 0


def test_decoding(spark, pieces, processor):
    ids = [[], [processor.piece_to_id("▁a"), processor.piece_to_id("b")], [processor.piece_to_id("<0xC3>")], [10**6], [-1], None, [1, processor.piece_to_id("▁a"), 2]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, ids array<int>").repartition(3)
    got = {r["i"]: r["decoded"] for r in S.decode(df, pieces).collect()}
    assert got == {0: "", 1: "ab", 2: "�", 3: None, 4: None, 5: None, 6: "a"}


def test_memory_does_not_grow_with_the_texts_of_a_batch(pieces):
    def peak(n):
        rng = np.random.default_rng(3)
        letters = np.array(list("aeioustrnlmdc"))
        texts = pa.array([" ".join("".join(letters[rng.integers(0, 13, 7)]) for _ in range(120)) for _ in range(n)])
        tracemalloc.start()
        for first, last in S.text_chunks(texts):
            S.segmentations(pieces, texts.slice(first, last - first).to_pylist(), np.arange(first, last, dtype=np.uint64), 2, 1.0)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(900) < 1.5 * peak(150)
