import json

import pytest
from pyspark.sql import functions as F

from chatprep.operators import batching as B
from chatprep.operators import chat as C
from chatprep.operators import context as X
from chatprep.operators import vocab as V
from chatprep.plans import prepare
from chatprep.sources import records as R
from chatprep.sources import tables as Tab
from tests import model


def said(df):
    return {r["rec_id"]: [(m["role"], m["content"]) for m in r["messages"]] for r in df.collect()}


def test_messages_of_all_layouts(records):
    found = said(
        C.chat_messages(
            records(
                {"system": " S ", "conversation": [{"human": " h ", "assistant": ""}, {"human": "", "assistant": " "}, {"human": None, "assistant": "a"}, {}]},
                {"instruction": "i", "extra": 1, "output": " o "},
                {"first": 1.0, "mid": 2, "last": True},
                {"first": None, "output": [1]},
                {"system": "S", "messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": [{"text": "a"}, {"text": "b"}]}]},
                {"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "content": "a"}, {"from": "system", "value": "s"}]},
            )
        )
    )
    assert found == {
        0: [("system", "S"), ("user", "h"), ("assistant", ""), ("user", "None"), ("assistant", "a")],
        1: [("user", "i"), ("assistant", " o ")],
        2: [("user", "1.0"), ("assistant", "True")],
        3: [("user", "None"), ("assistant", "[1]")],
        4: [("system", "S"), ("user", "u"), ("assistant", "ab")],
        5: [("user", "u"), ("assistant", "a"), ("system", "s")],
    }


def test_rendering(records, spark):
    chats = C.chat_messages(records({"instruction": "i", "output": "o"}))
    text = chats.select(C.render_chat(F.col("messages"), generation_prompt=True).alias("t")).first()["t"]
    assert text == "<|im_start|>user\ni<|im_end|>\n<|im_start|>assistant\no<|im_end|>\n<|im_start|>assistant\n"
    other = C.ChatTemplate("[{role}] ", "\n", {"assistant": ("> ", " <")}, "?")
    assert chats.select(C.render_chat(F.col("messages"), other).alias("t")).first()["t"] == "[user] i\n> o <"
    turns = spark.createDataFrame([(1, 0, "user", "i"), (1, 1, "assistant", "o")], "conv_id long, turn long, role string, text string")
    pieces = [r["piece"] for r in C.render_turns(turns, other).orderBy("turn").collect()]
    assert "".join(pieces) == "[user] i\n> o <"


@pytest.mark.parametrize("size", [1, 4, 7, 1000])
@pytest.mark.parametrize("group", [3, 50, None])
def test_packing_against_a_loop(spark, size, group):
    rows = [(i, list(range(i * 100, i * 100 + n))) for i, n in enumerate([3, 0, 12, 1, 1, 1, 30, 0, 2, 5])]
    df = spark.createDataFrame(rows, "k int, ids array<int>").repartition(4)
    got = C.pack(df, ["k"], F.col("ids"), F.size("ids"), size, group).collect()
    want = model.pack([ids for _, ids in rows], size, group or len(rows))
    assert sorted((r["group_id"], r["block_id"], r["ids"]) for r in got) == want


@pytest.mark.parametrize("size", [1, 4, 7, 100])
@pytest.mark.parametrize("group", [3, None])
def test_packing_text_equals_packing_its_ids(spark, size, group):
    texts = ["ab😀", "", "x\ny\r\n 　é" * 3, "😀", "c", chr(0x0F0B), "long " * 12, "", "é́", "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3)
    codec = V.Codec.of(V.build_vocab(df))
    by_ids = C.pack(df, ["k"], codec.encode(F.col("text"), False), F.length("text"), size, group)
    by_text = C.pack_text(df, ["k"], codec, max_len=size, rows_per_group=group)
    assert sorted(map(tuple, by_text.collect())) == sorted(map(tuple, by_ids.collect()))


def test_packed_text_keeps_order(spark):
    rows = [(i, f"text {i} " * (i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, text string").repartition(7)
    codec = V.Codec.of(V.build_vocab(df))
    got = C.pack_text(df, ["k"], codec, max_len=16, rows_per_group=50).select("group_id", "block_id", codec.decode(F.col("ids")).alias("t")).collect()
    for g in range(4):
        whole = "".join(t for _, t in rows[g * 50 : g * 50 + 50])
        text = "".join(r["t"] for r in sorted(got, key=lambda r: r["block_id"]) if r["group_id"] == g)
        assert text == whole[: len(whole) // 16 * 16]


def test_collate_masks_the_pad_id(spark):
    rows = [(1, 0, 0, [5, 0, 6]), (1, 0, 1, [7])]
    out = C.lm_collate(spark.createDataFrame(rows, "epoch int, batch_id long, row_in_batch int, ids array<int>"))
    got = {r["row_in_batch"]: (r["ids"], r["labels"]) for r in out.collect()}
    assert got == {0: ([5, 0, 6], [5, -100, 6]), 1: ([7, 0, 0], [7, -100, -100])}


def test_efficiency_adds_up(spark):
    df = spark.range(100).select("id", (F.col("id") % 13).alias("n"))
    row = C.pack_efficiency(df, ["id"], F.col("n"), max_len=10, rows_per_group=7).first()
    lengths = [i % 13 for i in range(100)]
    packed = model.pack([[0] * n for n in lengths], 10, 7)
    assert row["n_rows"] == 100 and row["real_ids"] == sum(lengths) and row["cut_ids"] == sum(min(n, 10) for n in lengths)
    assert row["packed_ids"] == sum(len(ids) for _, _, ids in packed)
    assert row["dropped_ids"] == sum(lengths) - row["packed_ids"] and row["padded_cells"] >= row["cut_ids"]


HISTORY = [(0, "user", "a"), (1, "system", "S1"), (2, "assistant", "b"), (3, "user", "c"), (4, "system", "S2"), (5, "assistant", "d"), (6, "user", "e")]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_context_window(spark, n):
    rows = [(conv, *m) for conv in (1, 2) for m in HISTORY[: 7 if conv == 1 else 4]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = X.context_window(turns, n).orderBy("section", "turn").collect()
    for conv, length in ((1, 7), (2, 4)):
        assert [(r["turn"], r["role"], r["text"]) for r in got if r["conv_id"] == conv] == model.context(HISTORY[:length], n)


def test_wide_context_windows(spark, monkeypatch):
    monkeypatch.setattr(X, "_TOP_K_PER_TASK", 1)
    rows = [(1, t, "system" if t % 50 == 7 else "user", str(t)) for t in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = X.context_window(turns, 40).orderBy("section", "turn").collect()
    assert [(r["turn"], r["role"], r["text"]) for r in got] == model.context([r[1:] for r in rows], 40)


def test_normalized_history(spark):
    past = spark.createDataFrame([(1, 0, "u1", "a1"), (1, 1, "u2", ""), (1, 2, "u3", None)], "conv_id long, pos int, user string, assistant string")
    prompts = spark.createDataFrame([(1, ' "p " ')], "conv_id long, prompt string")
    got = X.normalize_history(past, prompts).orderBy("is_prompt", "pos", "slot").collect()
    assert [(r["role"], r["content"]) for r in got] == [("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("user", "u3"), ("user", "p ")]


@pytest.mark.parametrize(("text", "system", "whole"), [(" u ", None, "u"), ("u", "", "u"), (" u ", " s ", "s\nu"), (" ", "s", "s"), ("u", " ", "u")])
def test_prompts(spark, text, system, whole):
    codec = V.Codec.of(V.build_vocab(spark.createDataFrame([("us\n",)], "text string")))
    df = spark.createDataFrame([(text, system)], "text string, system string")
    ids = [*model.encode(model.vocabulary(["us\n"]), whole), 1]
    assert df.select(X.prompt_ids(codec, F.col("text"), F.col("system")).alias("i")).first()["i"] == ids


@pytest.mark.parametrize(("block", "limit"), [(512, 252), (128, 8), (270, 10)])
def test_prompt_truncation(spark, block, limit):
    assert X.prompt_limit(block) == limit
    codec = V.Codec.of(V.build_vocab(spark.createDataFrame([("ab",)], "text string")))
    df = spark.createDataFrame([("ab" * n, None) for n in (1, 2, 3, 4, 5, 200)], "text string, system string")
    full = X.truncate_prompt(X.prompt_ids(codec, F.col("text"), F.col("system")), block)
    for r in X.build_prompts(df, codec, block).select("text", "ids", "n_full", full.alias("want")).collect():
        assert r["ids"] == r["want"] and len(r["ids"]) <= limit and r["n_full"] == len(r["text"]) + 3


def test_ways_through(spark, records, tmp_path):
    found = records(*[{"system": "S", "conversation": [{"human": f"h{i}", "assistant": f"a{i}"}, {"human": "x", "assistant": "y"}]} for i in range(40)])
    ready = prepare.training_set_from_records(found, "small", eval_ratio=0.25)
    counts = {r["split"]: r["count"] for r in ready.samples.groupBy("split").count().collect()}
    assert counts == {"train": 60, "val": 20} and ready.system == "S"
    for split, rows in (("train", 48), ("val", 20)):
        batches = prepare.epoch_batches(ready.samples, ["rec_id", "pos"], split, 1)
        assert batches.count() == rows
        assert batches.groupBy("batch_id").agg(F.countDistinct(F.size("x")).alias("w")).filter("w > 1").count() == 0
    assert prepare.epoch_batches(ready.samples, ["rec_id", "pos"], "train", 1, size="max").groupBy("batch_id").count().filter("count <> 4").count() == 0
    Tab.write_samples(ready.samples, str(tmp_path / "samples"))
    assert spark.read.parquet(str(tmp_path / "samples")).filter("split = 'val'").count() == 20
    codec = ready.codec
    blocks = prepare.finetune_blocks(found, codec.encode(F.col("text"), False), F.length("text"), max_len=64)
    assert {len(r["ids"]) for r in blocks.collect()} == {64}
    cut = prepare.finetune_blocks(found, codec.encode(F.col("text"), False), F.length("text"), max_len=10, packing=False)
    assert cut.count() == 40 and {len(r["ids"]) for r in cut.collect()} == {10}
    turns = spark.createDataFrame([(1, *m) for m in HISTORY], "conv_id long, turn long, role string, text string")
    prompts = spark.createDataFrame([(1, "why")], "conv_id long, prompt string")
    pieces = prepare.chat_prompts(turns, prompts, 1, C.ChatTemplate("{role}:", "|", {}, "assistant:")).orderBy("part", "section", "turn").collect()
    assert "".join(r["piece"] for r in pieces) == "system:S1|system:S2|assistant:d|user:e|user:why|assistant:"
    answered = turns.unionByName(spark.createDataFrame([(1, 7, "assistant", "f"), (2, 0, "user", "g"), (2, 1, "assistant", "h")], turns.schema))
    trained = prepare.training_set_from_turns(answered, "small", 0.5)
    assert sorted(r["split"] for r in trained.samples.collect()) == ["train", "val"] and trained.codec.size > 4


def test_from_files_to_blocks(spark, tmp_path):
    """Records of several files keep their file order through packing."""
    folder = tmp_path / "corpus.jsonl"
    folder.mkdir()
    for part in range(3):
        lines = [json.dumps({"instruction": f"q{part}.{i}", "output": f"a{part}.{i}"}) for i in range(20)]
        (folder / f"part-{part}").write_text("\n".join(lines) + "\n")
    found = prepare.open_records(spark, str(folder))
    ready = prepare.training_set_from_records(found, eval_ratio=0.1, first=R.first_line(spark, str(folder)))
    assert {r["split"]: r["count"] for r in ready.samples.groupBy("split").count().collect()} == {"train": 54, "val": 6}
    template = C.ChatTemplate("", "\n")
    codec = V.Codec.of(V.build_vocab(spark.createDataFrame([("qa.0123456789\n",)], "text string")))
    blocks = prepare.finetune_blocks(found, codec.encode(F.col("text"), False), F.length("text"), 32, template=template)
    text = "".join(r["t"] for r in blocks.orderBy("group_id", "block_id").select(codec.decode(F.col("ids")).alias("t")).collect())
    whole = "".join(f"q{p}.{i}\na{p}.{i}\n" for p in range(3) for i in range(20))
    assert text == whole[: len(whole) // 32 * 32]


def test_packing_conversations_against_a_loop(spark):
    """Groups are so many conversations, however long one of them is."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "abcdefg"[: 1 + (c + t) % 7]) for c in range(9) for t in range(200 if c == 4 else 3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    codec = V.Codec.of(V.build_vocab(spark.createDataFrame([("abcdefg<|im_start|>usertan\nd_i",)], "text string")))
    ids = codec.encode(F.col("piece"), add_special=False)
    pieces = {(r["conv_id"], r["turn"]): r["ids"] for r in C.render_turns(turns).select("conv_id", "turn", ids.alias("ids")).collect()}
    want = {}
    for g in range(3):
        flat = [i for c in range(g * 4, min(9, g * 4 + 4)) for t in range(200) for i in pieces.get((c, t), [])]
        blocks = [flat[k : k + 50] for k in range(0, len(flat) // 50 * 50, 50)] if len(flat) >= 50 else [flat]
        want |= {(g, b): block for b, block in enumerate(blocks)}
    for n_ids in (F.length("piece"), None):
        got = prepare.finetune_turns(turns, ids, n_ids, max_len=50, conversations=4).collect()
        assert {(r["group_id"], r["block_id"]): r["ids"] for r in got} == want


def test_fine_tuning_splits_and_collates(spark):
    rows = spark.createDataFrame([(i, [5] * (1 + i % 4) + [0]) for i in range(41)], "rec_id long, ids array<int>")
    train, val = (prepare.finetune_batches(rows, ["rec_id"], 0.1, split).collect() for split in ("train", "val"))
    assert len(val) == 4 and len(train) == 36 and not {r["rec_id"] for r in train} & {r["rec_id"] for r in val}
    for batch in (train, val):
        for r in batch:
            mates = [len(x["ids"]) for x in batch if x["batch_id"] == r["batch_id"]]
            assert len(set(mates)) == 1 and r["labels"] == [-100 if i == 0 else i for i in r["ids"]]


def test_prompts_can_keep_both_ends(spark):
    codec = V.Codec.of(V.build_vocab(spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz",)], "text string")))
    df = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz", None), ("abc", None)], "text string, system string")
    whole = df.select(X.prompt_ids(codec, F.col("text"), F.col("system")).alias("ids")).collect()
    got = [r["ids"] for r in X.build_prompts(df, codec, 273, 256, keep="ends").collect()]
    assert got == [whole[0]["ids"][:6] + whole[0]["ids"][-7:], whole[1]["ids"]]


def test_embeddings_from_pieces_to_a_checked_matrix(spark):
    vocab = spark.createDataFrame([(i,) for i in range(8)], "id int")
    source = spark.createDataFrame([(i, [float(i), 1.0, float(i * i), 0.5]) for i in range(4)], "source_id long, vec array<float>")
    pieces = spark.createDataFrame([(4 + i, 0, i) for i in range(4)], "id int, piece_pos int, source_id long")
    wide = {r["id"]: r["vec"] for r in prepare.initial_embeddings(pieces, source, vocab, 4, 6).collect()}
    assert wide[5] == [1.0, 1.0, 1.0, 0.5, 0.0, 0.0] and wide[0] == [0.0] * 6
    narrow = {r["id"]: r["vec"] for r in prepare.initial_embeddings(pieces, source, vocab, 4, 2).collect()}
    assert len(narrow) == 8 and all(len(v) == 2 for v in narrow.values())
