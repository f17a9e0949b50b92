import random

import pytest

from chatprep.operators import layout as L
from chatprep.operators import pairs as P
from chatprep.operators import vocab as V
from tests import model


def texts(df):
    return [(r["input"], r["output"]) for r in df.orderBy("rec_id", "pos").collect()]


def test_documented_layouts(records):
    paired = records({"instruction": "a", "output": "b"}, {"prompt": "c", "response": "d"})
    found, asked, answered = P.load_pairs(paired)
    assert (asked, answered) == ("instruction", "output") and texts(found) == [("a", "b")]
    turns = records({"system": "s", "conversation": [{"human": "h1", "assistant": "a1"}, {"human": "h2", "assistant": "a2"}]})
    assert texts(P.load_pairs(turns)[0]) == [("s\nh1", "a1"), ("s\nh1\na1\nh2", "a2")]
    messages = records({"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]})
    assert texts(P.load_pairs(messages)[0]) == [("u", "a")]
    shared = records({"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]})
    assert texts(P.load_pairs(shared)[0]) == [("u", "a")]


def test_printed_values(records):
    sides = ['"x"', "1.0", "1e5", "true", "false", "null", "[1, 2]", '{"a": 1}', '"true"', '"null"', "12345678901234567890123", "0.10", '" \'\\"q\\"\' "']
    found = P.pairs_from_records(records(*[f'{{"q": {s}, "a": "y"}}' for s in sides], '{"a": "y"}'), "q", "a")
    assert [i for i, _ in texts(found)] == [
        "x", "1.0", "100000.0", "True", "False", "None", "[1,2]", '{"a":1}', "true", "null", "12345678901234567890123", "0.1",
        '"q"',
    ]


def test_blank_sides_and_duplicates(records):
    found = P.pairs_from_records(
        records({"q": "\"''\"", "a": "y"}, {"q": "x", "a": " 　 "}, '{"q": "1", "q": "2", "a": "y"}'), "q", "a"
    )
    assert texts(found) == [("2", "y")]


def test_non_object_fails_or_is_left_out(records):
    found = records({"q": "x", "a": "y"}, "[1]")
    with pytest.raises(Exception, match="not an object"):
        P.pairs_from_records(found, "q", "a").collect()
    assert texts(P.pairs_from_records(found, "q", "a", strict=False)) == [("x", "y")]


def say(*speakers):
    return [{"role": {"u": "user", "a": "assistant", "s": "system"}[s[0]], "content": s[1:]} for s in speakers]


def test_messages_edges(records):
    found = P.pairs_from_messages(
        records(
            {"messages": say("u1", "u2", "a3", "a4", "u5")},
            {"system_prompt": "P", "messages": say("sX", "u1", "a2")},
            {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, "x", {"text": "b"}, {"image": 1}]}, *say("ak")]},
            {"messages": say("u  ", "ayes")},
            {"messages": say("ux", "a 　")},
            {"messages": say("u1", "sbreak", "a2")},
            {"messages": [*say("u1"), "noise", *say("a2")]},
            {"messages": say("uonly")},
            {"messages": "no list"},
            {"system": ["L", "M"], "messages": say("u1", "a2")},
            {"system": [1], "messages": say("u1", "a2")},
            {"system": 5, "system_prompt": "P", "messages": say("u1", "a2")},
            {"system": "", "system_prompt": "P", "messages": say("u1", "a2")},
            {"system": 0, "system_prompt": "P", "messages": say("u1", "a2")},
            {"messages": say("u[1, 2]", 'a{"k": true}')},
            {"messages": [{"role": "user", "content": None}, {"role": "assistant", "content": True}]},
            {"messages": [{"role": "user"}, {"role": "assistant", "content": 1.5}]},
        )
    )
    assert [(r["rec_id"], r["input"], r["output"]) for r in found.orderBy("rec_id", "pos").collect()] == [
        (0, "2", "3"), (1, "P\n1", "2"), (2, "ab", "k"), (3, "", "yes"), (9, "L\n1", "2"), (10, "1", "2"), (11, "1", "2"),
        (12, "P\n1", "2"), (13, "P\n1", "2"), (14, "[1, 2]", '{"k": true}'), (15, "None", "True"), (16, "", "1.5"),
    ]


def test_sharegpt_edges(records):
    def said(*pairs):
        return {"system": " S", "conversations": [{"from": who, "value": text} for who, text in pairs]}

    found = P.pairs_from_sharegpt(
        records(
            said(("human", "1"), ("gpt", "2"), ("user", "3"), ("model", "4"), ("human", "5"), ("bot", "6"), ("user", "7"), ("chatbot", "8")),
            {"conversations": [{"from": "human", "value": None, "content": "x"}, {"from": "gpt", "content": "y"}]},
            {"system": ["no"], "system_prompt": "no", "conversations": [{"from": "human", "value": "1"}, {"from": "gpt", "value": "2"}]},
        )
    )
    assert texts(found) == [("S\n1", "2"), ("S\n3", "4"), ("S\n7", "8"), ("None", "y"), ("1", "2")]


def test_turns_edges(records):
    found = P.pairs_from_turns(
        records(
            {"system": "  ", "conversation": [{"human": "1", "assistant": "2"}, {"human": " ", "assistant": "x"}, {"human": "3", "assistant": None}, "noise", {"human": "4 ", "assistant": "5"}]},
            {"conversation": []},
            {"conversation": "no"},
        )
    )
    assert texts(found) == [("1", "2"), ("1\n2\n4", "5")]


def _random_text(rng, blank=0.15):
    if rng.random() < blank:
        return rng.choice(["", " ", "　", "\n\t"])
    alphabet = "ab\"' \n　😀é" + chr(0x0F0B) + "[{1t"
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9)))


@pytest.mark.parametrize("seed", range(3))
def test_random_records_against_the_model(records, seed):
    rng = random.Random(seed)
    turn_raws, message_raws, turn_want, message_want = [], [], [], []
    for rec in range(40):
        system = rng.choice([None, "", " s ", _random_text(rng)])
        turns = [(rng.choice([None, _random_text(rng)]), _random_text(rng)) for _ in range(rng.randint(0, 7))]
        raw = {"conversation": [{"human": h, "assistant": a} for h, a in turns]}
        turn_raws.append(raw if system is None else {"system": system, **raw})
        turn_want += [(rec, *p) for p in model.turn_pairs(system or "", turns)]
        said = [(rng.choice(["user", "assistant", "system"]), _random_text(rng)) for _ in range(rng.randint(0, 9))]
        raw = {"messages": [{"role": r, "content": t} for r, t in said]}
        message_raws.append(raw if system is None else {"system": system, **raw})
        message_want += [(rec, *p) for p in model.message_pairs(system or "", said)]

    def rows(df):
        return [(r["rec_id"], r["input"], r["output"]) for r in df.orderBy("rec_id", "pos").collect()]

    found = records(*turn_raws)
    assert rows(P.pairs_from_turns(found)) == turn_want
    for limit in (1, 5, 12):
        assert rows(P.pairs_from_turns(found, limit)) == [(r, i[:limit], o) for r, i, o in turn_want]
    assert rows(P.pairs_from_messages(records(*message_raws))) == message_want
    whole = {c for r in V.pair_text(P.pairs_from_turns(found)).collect() for c in r["text"]}
    assert {c for r in P.turns_corpus(found).collect() for c in r["text"]} == whole


def test_mixed_corpus(records):
    found = P.pairs_of_mixed(
        records(
            {"q": "1", "a": "2"},
            {"messages": say("u3", "a4")},
            {"conversations": [{"from": "human", "value": "5"}, {"from": "gpt", "value": "6"}]},
            {"conversation": [{"human": "7", "assistant": "8"}]},
        ),
        ("q", "a"),
    )
    assert [(r["layout"], r["input"], r["output"]) for r in found.orderBy("rec_id").collect()] == [
        (L.PAIRED, "1", "2"), (L.MESSAGES, "3", "4"), (L.SHAREGPT, "5", "6"), (L.TURNS, "7", "8"),
    ]


def test_newline_joins_the_vocabulary_only_when_used(records):
    single = records({"conversation": [{"human": "a", "assistant": "b"}]})
    assert {c for r in P.turns_corpus(single).collect() for c in r["text"]} == {"a", "b", " "}


@pytest.mark.parametrize("limit", [None, 300])
def test_a_record_of_thousands_of_turns(records, limit):
    """Each pair takes its history when it is a row; offsets are right across blocks of turns."""
    turns = [{"human": f"h{i}" + "é" * (i % 5), "assistant": " " if i % 97 == 5 else f"a{i}"} for i in range(4000)]
    kept = [(t["human"], t["assistant"]) for t in turns if t["assistant"].strip()]
    found = P.pairs_from_turns(records({"system": "S", "conversation": turns}), limit)
    assert found.count() == len(kept)
    for n in (0, 1, 63, 64, 65, 200):
        at = turns.index({"human": kept[n][0], "assistant": kept[n][1]})
        row = found.filter(f"pos = {at}").first()
        whole = "\n".join(["S", *[f"{h}\n{a}" for h, a in kept[:n]], kept[n][0]])
        assert (row["input"], row["output"]) == (whole[:limit], kept[n][1])


def test_layouts_by_field_names(records):
    raws = [{"conversation": 1, "messages": []}, {"conversation": [], "messages": []}, {"messages": {}, "conversations": []}, {"messages": None}, [1], 7, '{"messages": [], "messages": 1}']
    found = records(*raws)
    from pyspark.sql import functions as F

    plain = [r[0] for r in found.orderBy("rec_id").select(L.layout_of(F.col("raw"))).collect()]
    named = L.by_layout(found).orderBy("rec_id").collect()
    assert [r["layout"] for r in named] == plain
    assert all([r[c] is not None for c in L.RAW.values()] == [name == r["layout"] for name in L.RAW] for r in named)


def test_record_drop_reasons(records):
    found = records(
        {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": " "}, {"role": "user", "content": "u"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]},
        {"messages": []},
        {"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}, 7]},
        {"conversation": [{"human": "h", "assistant": "a"}, {"human": "h"}, None]},
        {"q": "x", "a": "y"}, {"q": "", "a": "y"}, "[1]",
    )
    got = {(r["layout"], r["reason"]): r["n"] for r in P.record_drop_reasons(found, ("q", "a")).collect()}
    assert got == {
        ("messages", "blank_answer"): 1, ("messages", "not_asked"): 1, ("messages", "not_answered"): 1, ("messages", "paired"): 1, ("messages", "last"): 1,
        ("messages", "empty"): 1, ("sharegpt", "paired"): 1, ("sharegpt", "not_asked"): 1, ("sharegpt", "last"): 1,
        ("turns", "paired"): 1, ("turns", "blank_side"): 2, ("paired", "paired"): 1, ("paired", "blank_side"): 1, ("paired", "not_an_object"): 1,
    }


def test_fields_that_are_missing_null_or_blank(spark, records):
    """What the typed parse does not find is missing where no `null` stands in the record, and looked for elsewhere."""
    said = [
        {"from": "human", "value": "a"}, {"from": "gpt", "content": "b"}, {"from": "human", "value": "", "content": "c"}, {"from": "gpt", "value": "d"},
        {"from": "human", "content": "e"}, {"from": "gpt", "value": "f"}, {"from": "human"}, {"from": "gpt", "value": True},
    ]
    raws = [{"conversations": said}, {"conversations": [*said, {"from": "human", "value": "null"}, {"from": "gpt", "value": "g"}]}]
    raws += [{"conversations": [*said, {"from": "human", "value": None}, {"from": "gpt", "value": "h"}]}, {"conversations": [*said[:2], 5, *said[2:]]}, {"conversations": [*said[:2], None, [1], *said[2:]]}]
    got = [tuple(r) for r in P.pairs_from_sharegpt(records(*raws)).select("rec_id", "pos", "input", "output").orderBy("rec_id", "pos").collect()]
    base = [(0, "a", "b"), (2, "", "d"), (4, "e", "f"), (6, "", "True")]
    more = {0: base, 1: [*base, (8, "null", "g")], 2: [*base, (8, "None", "h")]}
    for i, shift in ((3, 1), (4, 2)):
        more[i] = [(pos + shift * (pos >= 2), asked, answer) for pos, asked, answer in base]
    assert got == [(i, *row) for i in sorted(more) for row in more[i]]
    frame = P.pairs_from_sharegpt(records(raws[0]))
    read = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(raw" in read.lower() and "_found" in read
