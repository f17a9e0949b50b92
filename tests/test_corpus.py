"""Loading a corpus as one step."""

import json

import pytest

from chatprep.operators import layout as L
from chatprep.operators import pairs as P
from chatprep.operators import samples as S
from chatprep.operators import vocab as V
from chatprep.plans import prepare

TURNS = [{"system": "S", "conversation": [{"human": f"h{i} é", "assistant": "a" * (i % 7)}, {"human": "x", "assistant": "y z"}]} for i in range(30)]
MESSAGES = [{"system": "one for all", "messages": [{"role": "user", "content": f"q{i}"}, {"role": "assistant", "content": "" if i % 4 == 0 else "b" * i}, {"role": "user", "content": "?"}]} for i in range(25)]
SHAREGPT = [{"conversations": [{"from": "ask" if i % 2 else "human", "value": f"v{i}"}, {"from": "told", "value": "w" * i}]} for i in range(25)] + [{"conversations": []}]
PAIRED = [{"prompt": f"p{i}", "output": "" if i % 5 == 0 else "long " * i} for i in range(40)]
CORPORA = {"turns": TURNS, "messages": MESSAGES, "sharegpt": SHAREGPT, "paired": PAIRED}
SPEAKERS = P.Speakers(humans=("human", "ask"), models=("told",))


def _texts(df):
    return sorted(tuple(r) for r in df.select("rec_id", "pos", "ids").collect())


@pytest.mark.parametrize("name", CORPORA)
def test_a_loaded_corpus_says_what_its_operators_say(records, name):
    raw = records(*CORPORA[name])
    got = prepare.load_corpus(raw, adapt=True, speakers=SPEAKERS)
    pairs, *keys = P.load_pairs(raw, speakers=SPEAKERS)
    profile = S.length_profile(pairs, "small").first()
    assert (got.layout, list(got.keys), got.longest, got.block_size) == (L.detect_layout(raw), keys, profile["longest"], profile["block_size"])
    vocabulary = V.build_vocab(V.pair_text(pairs))
    assert sorted(map(tuple, got.training.vocabulary.collect())) == sorted(map(tuple, vocabulary.collect()))
    want = S.make_samples(pairs, V.Codec.of(vocabulary), got.block_size)
    assert _texts(got.training.samples) == _texts(want)
    assert (got.n_records, got.n_samples, got.n_unknown) == (len(CORPORA[name]), pairs.count(), 0)
    reasons = {r["reason"]: r["n"] for r in P.record_drop_reasons(raw, ("prompt", "output"), SPEAKERS).collect()}
    assert got.reasons == reasons
    assert got.training.system == L.uniform_system(raw).first()["system"]
    assert tuple(got.summary().first()) == tuple(L.dataset_summary(pairs, *keys, got.training.system).first())


def test_a_given_vocabulary_counts_what_it_lacks(records):
    raw = records(*PAIRED)
    codec = V.Codec.of(V.build_vocab(raw.sparkSession.createDataFrame([("longp0123456789",)], "text string")))
    got = prepare.load_corpus(raw, codec=codec)
    ids = [i for r in got.training.samples.collect() for i in r["ids"]]
    assert got.longest is None and got.n_unknown == ids.count(3) > 0 and got.training.vocabulary is None


def test_nothing_to_pair(records):
    got = prepare.load_corpus(records({"prompt": "", "output": "x"}, {"prompt": "a", "output": ""}))
    assert (got.n_records, got.n_samples, got.n_unknown, got.longest, got.reasons) == (2, 0, 0, None, {"blank_side": 2})


def test_the_first_record_comes_with_the_corpus(spark, tmp_path):
    for i, part in enumerate((PAIRED[:3], PAIRED[3:])):
        (tmp_path / f"{i}.json").write_text(json.dumps(part))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text("\n".join(map(json.dumps, TURNS)))
    raw, first = prepare.open_corpus(spark, str(tmp_path / "*.json"))
    assert json.loads(first) == PAIRED[0] and raw.count() == len(PAIRED)
    raw, first = prepare.open_corpus(spark, str(tmp_path / "a" / "*.jsonl"))
    assert json.loads(first) == TURNS[0] and raw.count() == len(TURNS)


def test_speakers_of_other_names(records):
    from chatprep.operators import chat as C

    raw = records(*SHAREGPT)
    roles = [[m["role"] for m in r["messages"]] for r in C.chat_messages(raw, SPEAKERS).orderBy("rec_id").collect()]
    assert all(r == ["user", "assistant"] for r in roles[:-1]) and roles[-1] == []
    assert P.pairs_from_sharegpt(raw, SPEAKERS).count() == sum(1 for r in SHAREGPT if r["conversations"] and r["conversations"][1]["value"])
    assert P.pairs_from_sharegpt(raw).count() == 0
