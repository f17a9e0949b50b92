import random

import pytest
from tokenizers import Tokenizer, models

from chatprep.llm import wordpiece as P


def greedy(pieces, text):
    """Longest match first, one prefix after another; None if some place has none."""
    n = at = 0
    while at < len(text):
        to = next((to for to in range(len(text), at, -1) if text[at:to] in pieces), None)
        if to is None:
            return None
        at, n = to, n + 1
    return n


@pytest.mark.parametrize("seed", range(40))
def test_against_greedy_matching(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé") for _ in range(rng.randint(1, n)))
    pieces = [("" if rng.random() < 0.5 else "##") + word(4) for _ in range(rng.randint(1, 14))]
    words = [word(9).encode() for _ in range(50)]
    counts, unknown = P.from_wordpieces(pieces).counts(words)
    known = {b"\xfe" + p.encode() for p in pieces if not p.startswith("##")} | {p[2:].encode() for p in pieces if p.startswith("##")}
    for text, n, lost in zip(words, counts, unknown):
        want = greedy(known, b"\xfe" + text)
        assert (lost, n) == ((True, 1) if want is None else (False, want))


def test_against_a_wordpiece_tokenizer():
    rng = random.Random(1)
    pieces = {"[UNK]", *"abc", *(f"##{c}" for c in "abc"), "ab", "abc", "##ca", "##abca", "##bcab", "cab"}
    words = ["".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    other = Tokenizer(models.WordPiece({p: i for i, p in enumerate(sorted(pieces))}, unk_token="[UNK]", max_input_chars_per_word=1000))
    counts, _ = P.from_wordpieces(pieces - {"[UNK]"}).counts([w.encode() for w in words])
    assert counts.tolist() == [len(other.encode(w).ids) for w in words]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_vocabulary_files(name):
    automaton = P.load(f"/opt/tokenizers/{name}")
    counts, unknown = automaton.counts([b"the", b"x" * 5000, "日本".encode(), b"a"])
    assert counts[0] == counts[3] == 1 and 1 < counts[1] <= 5000 and not unknown.any()


def test_rows(spark):
    rows = [(1, "the cat\t\x0bsat\n", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, " \n ", None), (None, "the " * 200_000, "y"), (5, "q" * 300_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = P.token_counts(df, P.from_wordpieces(["the", "c", "##a", "##t", "sat", "q", "##qq"]))
    assert got.columns == ["doc_id", "text", "n_words", "n_tokens", "n_unknown"]
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_tokens"], r["n_unknown"]) for r in got.collect())
    assert found == [(0, 200_000, 200_000, 0), (1, 3, 5, 0), (2, 0, 0, 0), (3, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (5, 1, 1, 1)]
    assert P.token_counts(df.limit(0), P.from_wordpieces(["a"])).collect() == []
