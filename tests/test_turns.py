import random

import pytest

from chatprep.operators import turns as T
from chatprep.operators import vocab as V
from tests import model

SCHEMA = "conv_id long, turn long, role string, text string"


def _conversations(seed, n=12, longest=14):
    """Conversations with gaps in their turns, blank texts, and system turns anywhere or nowhere."""
    rng = random.Random(seed)
    rows = {}
    for conv in range(n):
        turns = sorted(rng.sample(range(longest * 2), rng.randint(1, longest)))
        roles = rng.choices(["user", "assistant", "system"], [5, 5, 1], k=len(turns))
        text = lambda: rng.choice(["", " ", "　x "] + ["".join(rng.choices("abc\n é", k=rng.randint(1, 8))) for _ in range(6)])
        rows[conv] = [(t, r, text()) for t, r in zip(turns, roles)]
    return rows


def _frame(spark, rows, parts=3):
    flat = [(c, *r) for c, turns in rows.items() for r in turns]
    random.Random(0).shuffle(flat)
    return spark.createDataFrame(flat, SCHEMA).repartition(parts)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("chunk", [2, 5, 4096])
def test_pairs_against_the_model(spark, seed, chunk):
    rows = _conversations(seed)
    turns = _frame(spark, rows)
    want = sorted((c, *p) for c, r in rows.items() for p in model.rows_to_message_pairs(r))
    assert sorted(tuple(r) for r in T.adjacent_pairs(turns, chunk).collect()) == want
    want = sorted((c, *p) for c, r in rows.items() for p in model.rows_to_turn_pairs(r))
    got = T.history_pairs(turns, chunk_turns=chunk).collect()
    assert sorted(tuple(r)[:4] for r in got) == want
    assert all(r["input_chars"] == len(r["input"]) for r in got)
    for limit in (1, 7, 20):
        cut = T.history_pairs(turns, limit, chunk).collect()
        assert sorted(tuple(r)[:4] for r in cut) == [(c, t, i[:limit], o) for c, t, i, o in want]
        assert sorted((r["conv_id"], r["turn"], r["input_chars"]) for r in cut) == [(c, t, len(i)) for c, t, i, _ in want]


@pytest.mark.parametrize("chunk", [3, 4096])
def test_corpus_has_the_characters_of_all_pairs(spark, chunk):
    turns = _frame(spark, _conversations(5))
    whole = {c for r in V.pair_text(T.history_pairs(turns)).collect() for c in r["text"]}
    assert {c for r in T.pair_corpus(turns, chunk).collect() for c in r["text"]} == whole


def test_one_plain_exchange_has_no_newline(spark):
    turns = _frame(spark, {0: [(0, "user", "a"), (1, "assistant", "b")]})
    assert {c for r in T.pair_corpus(turns).collect() for c in r["text"]} == {"a", "b", " "}


def test_every_turn_is_accounted_for(spark):
    rows = _conversations(7)
    for chunk in (3, 4096):
        counts = {r["reason"]: r["n_turns"] for r in T.drop_reasons(_frame(spark, rows), chunk).collect()}
        assert sum(counts.values()) == sum(len(r) for r in rows.values())
        assert counts["paired"] == sum(len(model.rows_to_turn_pairs(r)) for r in rows.values())


def test_one_conversation_may_hold_most_rows(spark):
    """A conversation far longer than a chunk keeps its order, history and neighbours."""
    n = 3000
    hot = [(t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(n)]
    turns = _frame(spark, {1: [(0, "system", "S"), *[(t + 1, r, x) for t, r, x in hot]], 2: [(0, "user", "u"), (1, "assistant", "a")]}, 8)
    got = {(r["conv_id"], r["turn"]): r for r in T.history_pairs(turns, max_chars=40, chunk_turns=64).collect()}
    assert len(got) == n // 2 + 1
    whole = "S\n" + "\n".join(f"t{t}" for t in range(n))
    for t in range(0, n, 2):
        before = whole[: whole.index(f"\nt{t}\n") + len(f"\nt{t}")] if t else "S\nt0"
        row = got[(1, t + 1)]
        assert row["input"] == before[:40] and row["input_chars"] == len(before) and row["output"] == f"t{t + 1}"


def test_negative_turns_stand_before_the_others(spark):
    """A chunk is counted from below, so it never holds turns of both signs."""
    rows = _conversations(11, longest=9)
    shifted = {c: [(t - 7, r, x) for t, r, x in turns] for c, turns in rows.items()}
    for chunk in (2, 4, 4096):
        for make in (T.adjacent_pairs, lambda t, n: T.history_pairs(t, chunk_turns=n), lambda t, n: T.history_pairs(t, 9, n)):
            want = sorted((r["conv_id"], r["turn"] - 7, r["input"], r["output"]) for r in make(_frame(spark, rows), chunk).collect())
            assert sorted(tuple(r)[:4] for r in make(_frame(spark, shifted), chunk).collect()) == want


def test_whole_histories_are_gathered_where_they_are_needed(spark, tmp_path):
    """No text is grouped by conversation alone: it goes from each chunk to each later one."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for c in range(20) for t in range(12 if c else 400)]
    path = str(tmp_path / "turns")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    text = T.history_pairs(spark.read.parquet(path), chunk_turns=8)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(conv_id#" in text
    for line in text.split("Exchange hashpartitioning(")[1:]:
        keys = line.split("\n")[0].rsplit(", ", 1)[0]
        assert "chunk#" in keys or "place#" in keys, keys
