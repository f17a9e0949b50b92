import os

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatprep.constants import BOS_ID, EOS_ID, N_SPECIAL, UNK_ID
from chatprep.functions.codec import detokenizer, pieces, register_tokenizer, register_tokenizer_spec, tokenizer
from chatprep.operators import samples as S
from chatprep.operators import vocab as V
from tests import model

UNK = chr(0x0F0B)
TEXTS = ["plain", "é à", "漢字 漢", "😀 astral 👩‍👩", "combining é", "line\nbreak\ttab", f"known {UNK} unknown", "", " ", "~<pad>"]


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string").repartition(4)


def test_vocabulary(corpus):
    rows = V.build_vocab(corpus).orderBy("id").collect()
    want = model.vocabulary(TEXTS)
    assert [(r["ch"], r["id"]) for r in rows] == list(want.items())
    assert V.vocab_size(V.build_vocab(corpus)).first()[0] == len(want)


def test_encode_forms_agree(spark, corpus):
    want = model.vocabulary(TEXTS[:4])
    vocab = V.build_vocab(corpus.filter("k < 4"))
    codec = V.Codec.of(vocab)
    got = {r["k"]: (r["a"], r["b"]) for r in corpus.select("k", codec.encode(F.col("text")).alias("a"), codec.encode(F.col("text"), False).alias("b")).collect()}
    joined = {r["k"]: r["ids"] for r in V.encode_by_join(corpus, vocab, ["k"]).collect()}
    arrow = {r["k"]: r["ids"] for r in corpus.select("k", V.arrow_encoder(codec)("text").alias("ids")).collect()}
    assert arrow == joined
    for k, text in enumerate(TEXTS):
        assert got[k][0] == model.encode(want, text)
        assert got[k][1] == joined[k] == model.encode(want, text)[1:-1]


def test_decode(spark, corpus):
    codec = V.Codec.of(V.build_vocab(corpus))
    ids = corpus.select("k", "text", codec.encode(F.col("text")).alias("ids"))
    for r in ids.select("text", codec.decode(F.col("ids")).alias("d"), codec.decode(F.col("ids"), False).alias("all")).collect():
        assert r["d"] == r["text"].replace(UNK, "")
        assert r["all"] == f"<bos>{r['text']}<eos>"
    odd = spark.createDataFrame([([4, 0, 9999, 3, 5],)], "ids array<int>")
    texts = sorted(set("".join(TEXTS)) - {UNK})
    row = odd.select(codec.decode(F.col("ids")).alias("d"), codec.decode(F.col("ids"), False).alias("all")).first()
    assert row["d"] == texts[0] + UNK + texts[1]
    assert row["all"] == texts[0] + "<pad>" + UNK + UNK + texts[1]


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "text string")
    codec = V.Codec.of(V.build_vocab(none))
    assert codec.size == 4
    row = spark.createDataFrame([("ab",)], "t string").select(codec.encode(F.col("t")).alias("i")).first()
    assert row["i"] == [1, 3, 3, 2]


def test_counts(spark, corpus):
    counts = {r["ch"]: r["n"] for r in V.char_frequency(corpus).collect()}
    whole = "".join(TEXTS)
    assert counts == {c: whole.count(c) for c in set(whole)}
    pruned = V.prune_vocab(V.char_frequency(corpus), 5).collect()
    assert {r["ch"] for r in pruned if r["id"] > 3} == {c for c in set(whole) if whole.count(c) >= 5}
    unknown = {r["ch"]: r["n"] for r in V.oov_report(corpus, V.build_vocab(corpus.filter("k < 4"))).collect()}
    known = set("".join(TEXTS[:4]))
    assert unknown == {c: whole.count(c) for c in set(whole) - known}


def test_samples(spark):
    pairs = spark.createDataFrame([(0, "ab", "cd"), (1, "", "x"), (2, "a" * 50, "b")], "k int, input string, output string")
    codec = V.Codec.of(V.build_vocab(V.pair_text(pairs)))
    want = model.vocabulary(["ab cd", " x"])
    for block in (1, 2, 3, 7, 8, 52, 200):
        got = {r["k"]: r["ids"] for r in S.make_samples(pairs, codec, block).collect()}
        whole = {r["k"]: (model.encode(want, r["input"]) + model.encode(want, r["output"]))[:block] for r in pairs.collect()}
        assert got == {k: ids for k, ids in whole.items() if len(ids) >= 2}
    shifted = S.shift_targets(S.make_samples(pairs, codec, 200)).collect()
    for r in shifted:
        assert r["x"][1:] == r["y"][:-1] and r["x"][0] == 1 and r["y"][-1] == 2
    masked = S.loss_mask(spark.createDataFrame([([4, 0, 5, 0, 0],)], "y array<int>")).first()
    assert masked["mask"] == [True, False, True, False, False] and masked["n_counted"] == 2


@pytest.mark.parametrize(("length", "preset", "block"), [(3, "small", 128), (300, "small", 304), (300, "large", 512), (5000, "small", 2048)])
def test_length_profile(spark, length, preset, block):
    pairs = spark.createDataFrame([("a" * (length - 1), "b")], "input string, output string")
    row = S.length_profile(pairs, preset).first()
    assert (row["longest"], row["block_size"]) == (length + 4, block)


def test_outside_tokenizer(spark):
    register_tokenizer("words", lambda texts: pd.Series([[len(w) for w in t.split()] for t in texts]))
    df = spark.createDataFrame([("a bb ccc",)], "t string")
    assert df.select(tokenizer("words")(F.col("t")).alias("i")).first()["i"] == [1, 2, 3]


def counting_tokenizer(log: str, scale: int):
    """Writes a line whenever it is made."""
    with open(log, "a") as out:
        out.write(f"{os.getpid()}\n")
    return lambda texts: [[len(w) * scale for w in t.split()] for t in texts]


@pytest.mark.parametrize("kind", ["arrow", "series"])
def test_a_worker_makes_its_tokenizer_once(spark, tmp_path, kind):
    log = str(tmp_path / "made")
    register_tokenizer_spec("counted", "tests.test_vocab:counting_tokenizer", kind=kind, log=log, scale=10)
    texts = spark.range(40_000).repartition(12).selectExpr("id", "if(id % 10 = 0, null, concat('a ', repeat('b', id % 7))) as t")
    got = texts.select("id", tokenizer("counted")(F.col("t")).alias("ids")).collect()
    for r in got:
        n = r["id"] % 7
        assert r["ids"] == (None if r["id"] % 10 == 0 else [10] + [10 * n] * (n > 0))
    made = open(log).read().split()
    assert made and len(made) == len(set(made))


def test_tokenizer_kinds(spark):
    with pytest.raises(ValueError, match="arrow or series"):
        register_tokenizer_spec("x", "tests.test_vocab:counting_tokenizer", kind="rows")


def test_batches_reach_tokenizers_in_pieces(spark):
    """A batch of many or long texts is never made into ids as a whole; a text is never cut."""
    texts = ["", None, "a" * 5, "é" * 40, "b", None, "c" * 3]
    column = pa.array(texts)
    for most in (1, 4, 10, 1000):
        found = [p.to_pylist() for p in pieces(column, most)]
        assert sum(found, []) == texts
        assert all(sum(len((t or "").encode()) for t in p[:-1]) <= most for p in found)
    assert [p.to_pylist() for p in pieces(pa.array([[1, 2], None, [], [3]], pa.list_(pa.int32())), 8)] == [[[1, 2]], [None, [], [3]]]
    assert list(pieces(pa.array([], pa.string()))) == []
    longest = 3 << 20

    def met(batch):
        assert batch.str.len().sum() <= longest
        return batch.map(lambda t: [len(t)])

    register_tokenizer("met", met)
    register_tokenizer_spec("met_arrow", "tests.test_vocab:bounded_tokenizer", longest=longest)
    rows = spark.range(24).coalesce(1).select("id", F.repeat(F.lit("漢x"), 1 << 18).alias("t"))
    for name in ("met", "met_arrow"):
        assert [r["ids"] for r in rows.select(tokenizer(name)("t").alias("ids")).collect()] == [[1 << 19]] * 24


def test_a_join_moves_no_row_per_character(spark):
    """What is exploded and shuffled grows with the distinct characters of a text; keys may be null or repeated."""
    texts = [(1, "ab" * 5000), (2, "漢" * 9000 + "z"), (3, ""), (4, None), (None, "bb"), (1, "ab" * 5000), (1, "ba"), (None, None)]
    df = spark.createDataFrame(texts, "k int, text string").coalesce(1)
    vocab = spark.createDataFrame([("<pad>", 0), ("<bos>", 1), ("<eos>", 2), (UNK, 3), ("a", 4), ("b", 5), ("漢", 6)], "ch string, id int")
    counted = V.encode_by_join(df, vocab, ["k"])
    exploded = [n for n in str(counted._jdf.queryExecution().optimizedPlan()).splitlines() if "posexplode" in n]
    assert len(exploded) == 1 and "array_distinct" in exploded[0]
    found = sorted(((r["k"], r["ids"]) for r in counted.collect()), key=repr)
    ids = {"a": 4, "b": 5, "漢": 6}
    assert found == sorted(((k, [ids.get(c, 3) for c in t or ""]) for k, t in texts), key=repr)


def bounded_tokenizer(longest: int):
    def ids(texts):
        assert sum(map(len, texts)) <= longest
        return [[len(t)] for t in texts]

    return ids


def test_ids_told_back(spark):
    """Every worker makes its detokenizer once; null ids stay null."""
    told = detokenizer("tests.test_vocab:joining_detokenizer", sep="-")
    rows = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k int, ids array<int>")
    assert {r["k"]: r["t"] for r in rows.select("k", told(F.col("ids")).alias("t")).collect()} == {1: "1-2", 2: "", 3: None}


def joining_detokenizer(sep: str):
    return lambda ids: [sep.join(map(str, x)) for x in ids]


@pytest.mark.parametrize("arrow", [True, False])
@pytest.mark.parametrize("block", [1, 3, 5, 6, 7, 12, 200])
def test_samples_of_cut_texts(spark, block, arrow):
    """Ids cut and framed as by encoding both sides whole; over Arrow batches no character is looked up by itself."""
    rows = [(i, a, b) for i, (a, b) in enumerate([("ab", "c"), ("", ""), (None, "abc"), ("abc", None), ("😀b", "é😀" * 9), ("abcabcabc", "cab"), ("z", "ß" * 400)])]
    codec = V.Codec.of(V.build_vocab(spark.createDataFrame([("abcé😀",), (None,), ("",)], "text string")))
    made = S.make_samples(spark.createDataFrame(rows, "k int, input string, output string"), codec, block, arrow)
    ids = {c: i for i, c in enumerate(sorted("abcé😀"), N_SPECIAL)}

    def framed(text):
        return [BOS_ID, *(ids.get(c, UNK_ID) for c in text or ""), EOS_ID]

    want = {k: (framed(a) + framed(b))[:block] for k, a, b in rows}
    assert {r["k"]: r["ids"] for r in made.collect()} == {k: x for k, x in want.items() if len(x) >= 2}
    assert ("ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()) == arrow
