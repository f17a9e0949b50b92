import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chatprep.constants import WHITESPACE
from chatprep.functions.text import clean, clean_keep_inner_space, excerpt, strip
from chatprep.operators import layout as L
from chatprep.operators import pairs as P
from chatprep.sources import jsondocs
from chatprep.sources import records as R
from chatprep.sources import shared
from chatprep.sources import tables as Tab

PAIR = {"instruction": "ask", "output": "tell"}


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_strip_and_clean(spark):
    texts = ["  \"'hi'\"  ", "　 a b\u0085", "\"\"''\"", "plain", "", "'\"x\"'", "\x1cq\x1f", "a​b​"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", strip(F.col("t")), clean(F.col("t")), clean_keep_inner_space(F.col("t"))).collect()
    for text, stripped, cleaned, kept in got:
        assert stripped == text.strip()
        assert kept == text.strip().strip('"').strip("'")
        assert cleaned == kept.strip()


def test_whitespace_is_all_of_it():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_excerpt_marks_only_cuts(spark):
    df = spark.createDataFrame([("abc",), ("abcd",), ("",)], "t string")
    assert values(df.select(excerpt(F.col("t"), 3).alias("e")), "e") == [("abc",), ("abc...",), ("",)]


def test_jsonl_order_blank_lines_and_many_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\n  {"input": "1", "output": "a"}  \n\n　\n{"input": "2", "output": "b"}\n', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"x": "3", "output": "c"}\n', encoding="utf-8")
    found = R.read_jsonl(spark, str(tmp_path / "*.jsonl"))
    assert [json.loads(r["raw"]) for r in found.orderBy("rec_id").collect()] == [
        {"input": "1", "output": "a"}, {"input": "2", "output": "b"}, {"x": "3", "output": "c"},
    ]
    assert L.detect_keys(found) == ("input", "output")
    assert sorted(values(P.load_pairs(found)[0], "input", "output")) == [("1", "a"), ("2", "b")]


@pytest.mark.parametrize(
    ("document", "expected"),
    [
        ([PAIR, PAIR], [PAIR, PAIR]),
        ({"data": [PAIR], "meta": {"a": [1]}}, [PAIR]),
        ({"other": [1], "data": [PAIR]}, [PAIR]),
        ({"meta": 1, "rows": [PAIR], "other": [2]}, [PAIR]),
        ({"meta": "[1]", "rows": [PAIR]}, [PAIR]),
        ({"data": {"a": 1}, "rows": [PAIR]}, [PAIR]),
        (PAIR, [PAIR]),
    ],
)
def test_json_documents(spark, tmp_path, document, expected):
    path = tmp_path / "d.json"
    path.write_text(json.dumps(document, indent=1))
    found = R.read_json(spark, str(path)).orderBy("rec_id").collect()
    assert [json.loads(r["raw"]) for r in found] == expected


@pytest.mark.parametrize("document", [[], {"data": []}])
def test_empty_documents_are_an_error(spark, tmp_path, document):
    path = tmp_path / "d.json"
    path.write_text(json.dumps(document))
    with pytest.raises(R.CorpusError, match="empty"):
        P.load_pairs(R.read_json(spark, str(path)))


@pytest.mark.parametrize("document", ["text", 3])
def test_scalar_documents_are_an_error(spark, tmp_path, document):
    path = tmp_path / "d.json"
    path.write_text(json.dumps(document))
    with pytest.raises(R.CorpusError, match="unsupported"):
        P.load_pairs(R.read_json(spark, str(path)))


def test_corrupt_lines(spark, records):
    found = records(PAIR, "{bad", "[1]", PAIR)
    good, bad = R.split_corrupt(found)
    assert good.count() == 2 and sorted(values(bad, "_corrupt")) == [("[1]",), ("{bad",)]
    with pytest.raises(Exception, match="not a JSON object"):
        R.strict_objects(found).collect()


@pytest.mark.parametrize(
    ("keys", "chosen"),
    [
        (["instruction", "output"], ("instruction", "output")),
        (["foo", "bar", "baz"], ("foo", "baz")),
        (["foo", "answer"], ("foo", "answer")),
        (["zeta", "input"], ("input", "zeta")),
        (["output", "text", "prompt"], ("prompt", "output")),
        (["a", "text", "z"], ("text", "z")),
    ],
)
def test_choose_keys(keys, chosen):
    assert L.choose_keys(keys) == chosen


@pytest.mark.parametrize("keys", [["only"], []])
def test_too_few_keys(keys):
    with pytest.raises(R.CorpusError):
        L.choose_keys(keys)


def test_layout_precedence(records):
    both = {"conversations": [], "messages": [], "conversation": []}
    assert L.detect_layout(records(both)) == L.TURNS
    assert L.detect_layout(records({"conversations": [], "messages": []})) == L.MESSAGES
    assert L.detect_layout(records({"conversations": [], "messages": "x"})) == L.SHAREGPT
    assert L.detect_layout(records({"conversations": "[]"})) == L.PAIRED


@pytest.mark.parametrize(
    ("systems", "expected"),
    [
        (["a", "a"], "a"), (["a", "b"], None), ([None, "a", "a"], "a"), (["a", None], None),
        (["-", "-"], None), (["", ""], None), (["-", "a"], None), ([None, None], None),
    ],
)
def test_uniform_system(records, systems, expected):
    raws = [{"x": 1} if s == "-" else {"x": 1, "system": s} for s in systems]
    assert L.uniform_system(records(*raws)).first()["system"] == expected


def test_uniform_system_skips_non_objects_but_not_broken_ones(records):
    assert L.uniform_system(records({"system": "a"}, "3", {"system": "a"})).first()["system"] == "a"
    assert L.uniform_system(records({"system": "a"}, "{bad")).first()["system"] is None


def test_summary_and_preview(spark, records):
    pairs = P.pairs_from_records(records(*[{"q": "x" * 130, "a": str(i)} for i in range(1, 4)]), "q", "a")
    assert L.dataset_summary(pairs, "q", "a", "s" * 50).first().asDict() == {
        "n_pairs": 3, "input_key": "q", "output_key": "a", "system_excerpt": "s" * 40 + "...",
    }
    assert values(L.preview(pairs, ["rec_id"]), "input", "output") == [("x" * 120 + "...", "1"), ("x" * 120 + "...", "2")]


def test_vocabulary_files(spark, tmp_path):
    rows = [("<pad>", 0), ("<bos>", 1), ("<eos>", 2), (chr(0x0F0B), 3), ("\n", 4), ('"', 5), ("é", 6), ("😀", 7)]
    vocab = spark.createDataFrame(rows, "ch string, id int")
    Tab.write_vocab(vocab, str(tmp_path / "v"))
    assert sorted(values(Tab.read_vocab(spark, str(tmp_path / "v")), "id", "ch")) == sorted((i, c) for c, i in rows)
    state = Tab.vocab_to_json(vocab)
    assert json.loads(state.first()["state"]) == {"stoi": dict(rows), "itos": {str(i): c for c, i in rows}}
    assert sorted(values(Tab.vocab_from_json(state), "ch", "id")) == sorted(rows)


def test_the_first_record_is_looked_for_in_the_first_file(spark, tmp_path):
    (tmp_path / "a b.jsonl").write_text("\n \n")
    (tmp_path / "b.jsonl").write_text('{"q": "first", "a": "1"}\n{"q": "second", "a": "1"}\n')
    (tmp_path / "c.jsonl").write_text('{"q": "third", "a": "1"}\n')
    assert json.loads(R.first_record(R.read_jsonl(spark, str(tmp_path))))["q"] == "first"
    assert json.loads(R.first_line(spark, str(tmp_path)))["q"] == "first"
    assert texts_of(P.load_pairs(R.read_jsonl(spark, str(tmp_path)), first=R.first_line(spark, str(tmp_path)))[0]) == ["first", "second", "third"]


def texts_of(pairs):
    return sorted(r["input"] for r in pairs.collect())


def test_shared_tables_need_a_folder_and_go_with_their_scope(spark, tmp_path):
    class Context:
        def getCheckpointDir(self):
            return None

    class Bare:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Bare())
    with shared.scratch(spark):
        kept = shared.stored(spark.range(3), "numbers")
        folder = Path(kept.inputFiles()[0].removeprefix("file://").removeprefix("file:")).parent
        assert kept.count() == 3 and folder.is_dir()
    assert not folder.exists()


def _value(rng, depth=0):
    if depth > 3 or rng.random() < 0.4:
        return "".join(rng.choice(["a", '"', "\\", "[", "]", "{", "}", ",", ":", "é", "日", " ", "\n", '\\"']) for _ in range(rng.randint(0, 12)))
    if rng.random() < 0.3:
        return [_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {_value(rng, 9): rng.choice([1, 2.5, None, True, _value(rng, depth + 1)]) for _ in range(rng.randint(0, 4))}


@pytest.mark.parametrize("split, chunk", [(9, 4), (64, 16), (300, 1 << 20)])
def test_documents_by_ranges_equal_documents_as_rows(spark, tmp_path, split, chunk):
    """Ranges cut strings, escapes, characters and field names; lists hold brackets in strings, nothing, or anything."""
    rng = random.Random(split)
    docs = []
    for _ in range(6 if split < 64 else 20):
        name = rng.choice([lambda: "data", lambda: 'x"[', lambda: "m\\", lambda: _value(rng, 9)])
        docs.append([_value(rng) for _ in range(rng.randint(0, 6))] if rng.random() < 0.5 else {name(): _value(rng) for _ in range(rng.randint(1, 5))})
    texts = [" \n" * rng.randint(0, 2) + json.dumps(d, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) + " " * rng.randint(0, 2) for d in docs]
    texts += ["[]", " [ ] ", '{"a": []}', "{}", '{"a": 1, "a": [1, 2], "b": [3]}', '{"a": [1], "b": [2], "a": 3}', "[[[]], {}]", '["\\\\", "\\\\\\""]']
    for i, text in enumerate(texts):
        (tmp_path / f"{i:03d}.json").write_text(text, encoding="utf-8")

    def rows(df):
        return [(r["rec_id"]["doc"], r["raw"]) for r in df.orderBy("rec_id").collect()]

    want = rows(R.read_json_whole(spark, str(tmp_path)))
    assert rows(R.read_json(spark, str(tmp_path), split)) == want
    assert [r for r in rows(jsondocs.split_documents(spark, str(tmp_path), split, chunk)) if len(texts[int(r[0][-8:-5])].encode()) > split] == [
        r for r in want if len(texts[int(r[0][-8:-5])].encode()) > split
    ]


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a"', '[1, "abc', '"a string of some length"', "12345678901234567890", "      \n      ", '{"a": [1, 2}  '])
def test_broken_documents_are_one_null_record(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    assert [r["raw"] for r in R.read_json(spark, str(tmp_path), 4).collect()] == [None]


def test_a_task_reads_a_range(spark, tmp_path):
    """As many tasks as ranges, and no more of a file in one than its range and an element."""
    (tmp_path / "x.json").write_text(json.dumps([{"k": "v" * 90, "i": i} for i in range(2000)]))
    size = (tmp_path / "x.json").stat().st_size
    df = R.read_json(spark, str(tmp_path), size // 10 + 1)
    per_task = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in per_task) == 2000 and len(per_task) >= 5 and max(r["n"] for r in per_task) < 1000


def test_short_ranges_share_tasks(spark, tmp_path):
    """Tasks grow with the bytes, not with the number of ranges."""
    (tmp_path / "x.json").write_text(json.dumps([{"k": "v" * 90, "i": i} for i in range(2000)]))
    df = jsondocs.split_documents(spark, str(tmp_path), (tmp_path / "x.json").stat().st_size // 100)
    per_task = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in per_task) == 2000 and len(per_task) <= 3 * spark.sparkContext.defaultParallelism
