"""What must hold of the physical plans, whatever the size of the data."""

import re

import pytest
from pyspark.sql import functions as F

from chatprep.operators import batching as B
from chatprep.operators import chat as C
from chatprep.operators import context as X
from chatprep.operators import pairs as P
from chatprep.operators import samples as S
from chatprep.operators import scores as G
from chatprep.operators import turns as T
from chatprep.operators import vocab as V

TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture
def turns(spark, tmp_path):
    """Long enough for two chunks of 8, stored, so that plans start at a scan."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for c in range(20) for t in range(12 if c else 400)]
    path = str(tmp_path / "turns")
    spark.createDataFrame(rows, TURNS).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange (\w+(?:\([^)]*\))?)", plan(df))


def test_turns_move_once(turns):
    codec = V.Codec.of(V.build_vocab(T.pair_corpus(turns)))
    made = S.make_samples(T.history_pairs(turns, 64), codec, 64)
    assert [re.sub(r"#\d+L?", "", e) for e in exchanges(made)] == ["hashpartitioning(conv_id, chunk, 4)"]
    assert "Python" not in plan(made)


def test_shuffled_turns_carry_each_text_once(turns):
    moved = plan(T.history_pairs(turns, 64)).split("Exchange hashpartitioning")[1].split("\n")[1]
    assert "struct(" not in moved


def test_a_long_conversation_never_meets_in_one_task(spark, turns):
    """Only per-chunk rows go by conversation alone, and they come out of an aggregate."""
    text = plan(T.history_pairs(turns, 64, chunk_turns=8))
    for match in re.finditer(r"Exchange hashpartitioning\(conv_id#\d+L, \d+\)", text):
        below = text[match.end() :].split("\n", 2)[1]
        assert "Aggregate" in below, below
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = T.turns_in_context(turns, 8).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in rows) < 0.5 * sum(r["count"] for r in rows)


def test_split_moves_nothing(turns):
    assert exchanges(B.train_val_split(turns, ["conv_id", "turn"], 0.1)) == []


def test_only_counted_or_distinct_rows_reach_a_single_task(turns):
    for df in (
        V.build_vocab(T.pair_corpus(turns)),
        B.assign_batches(turns.select("conv_id", "turn"), ["conv_id", "turn"]),
    ):
        text = plan(df)
        assert "SinglePartition" in text
        for part in text.split("Exchange SinglePartition")[1:]:
            assert "Aggregate" in "".join(part.split("\n")[1:4])


def test_top_k_is_cut_before_the_shuffle(spark, turns):
    assert plan(X.context_window(turns, 2)).count("WindowGroupLimit") == 2
    scores = spark.range(100).select((F.col("id") % 3).alias("ctx_id"), F.col("id").alias("token_id"), F.rand(1).alias("score"))
    text = plan(G.topk_filter(scores, 5))
    assert text.count("WindowGroupLimit") >= 4
    assert not re.search(r"Exchange hashpartitioning\(ctx_id#\d+L, \d+\)[^\n]*\n[^\n]*Range", text)


def test_scans_read_what_is_asked(turns):
    lengths = T.history_pairs(turns, 1).select("conv_id", "turn")
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan(lengths)
    counted = turns.filter(X.is_system()).groupBy("conv_id").count()
    assert "ReadSchema: struct<conv_id:bigint,role:string>" in plan(counted)


def test_arrays_are_parsed_once(records):
    """No filter on a parsed array is pushed below, where it would parse the record again."""
    found = records({"conversation": [{"human": "h", "assistant": "a"}]})
    for df in (P.pairs_from_turns(found), P.pairs_from_messages(found), P.pairs_from_sharegpt(found), P.pairs_from_records(found, "a", "b")):
        for line in plan(df).split("\n"):
            assert not (line.lstrip(" +-:*()0123456789").startswith("Filter") and "from_json" in line), line


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitioning(turns, parts):
    moved = turns.repartition(parts)
    codec = V.Codec.of(V.build_vocab(T.pair_corpus(moved)))

    def batches(df):
        made = S.shift_targets(S.make_samples(T.history_pairs(df, 64, chunk_turns=16), codec, 64))
        return sorted(map(str, B.pad_batches(B.assign_batches(made, ["conv_id", "turn"])).collect()))

    assert batches(moved) == batches(turns)


def test_a_packed_text_moves_once(spark, tmp_path):
    """By range, before the plan that is left: in that only pieces at the ends of parts do."""
    path = str(tmp_path / "texts")
    spark.range(500).selectExpr("id as k", "repeat('ab ', cast(id % 50 as int)) as text").write.parquet(path)
    texts = spark.read.parquet(path)
    codec = V.Codec.of(V.build_vocab(texts))
    for group in (40, None):
        packed = C.pack_text(texts, ["k"], codec, max_len=64, rows_per_group=group)
        assert [re.sub(r"#\d+L?", "", e) for e in exchanges(packed)] == ["hashpartitioning(group_id, block_id, 4)"]
        assert "part" in plan(packed) and "Filter" in plan(packed)
