"""Records to (input, output) pairs, one record at a time.

Everything here is a column expression on one row followed by an explode: no shuffle, and
the same code runs on a stream. Row-per-turn tables are in `turns`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chatprep.constants import HUMAN_ALIASES, MODEL_ALIASES
from chatprep.functions import jsonvals as J
from chatprep.functions.rows import each_value, settled
from chatprep.functions.text import blank_to_null, clean, join_lines, or_empty, strip
from chatprep.operators import layout as L
from chatprep.sources.records import assert_records


@dataclass(frozen=True)
class Speakers:
    """What the two sides of a `conversations` record are called."""

    humans: tuple[str, ...] = tuple(HUMAN_ALIASES)
    models: tuple[str, ...] = tuple(MODEL_ALIASES)


SPEAKERS = Speakers()


def _kept(records: DataFrame) -> list[str]:
    return [c for c in records.columns if c != "raw"]


def _pair(pos: Column, asked: Column, answer: Column, told: Column | None = None) -> Column:
    """A pair; `told` is the length of the history in front of it, null if it has none of its own."""
    told = F.lit(None) if told is None else told
    return F.struct(pos.alias("pos"), asked.alias("input"), answer.alias("output"), told.cast("bigint").alias("told"))


def _exploded(parsed: DataFrame, kept: list[str], pairs: Column) -> DataFrame:
    """`(kept..., pos, input, output)` from an array of pairs per record."""
    return each_value(parsed, kept, pairs, "_pair").select(*kept, "_pair.pos", "_pair.input", "_pair.output")


def _exploded_with_history(parsed: DataFrame, kept: list[str], pairs: Column, max_chars: int | None) -> DataFrame:
    """`_exploded`, each pair with the beginning of `_told` that it says; no row holds more than one history."""

    def cut(text: Column) -> Column:
        return text if max_chars is None else F.substring(text, 1, max_chars)

    rows = each_value(parsed, [*kept, "_told", "_system"], pairs, "_pair")
    earlier = blank_to_null(F.substring("_told", F.lit(1), F.col("_pair.told").cast("int")))
    asked = F.when(F.col("_pair.told").isNotNull(), cut(join_lines(F.col("_system"), earlier, F.col("_pair.input"))))
    return rows.select(*kept, "_pair.pos", F.coalesce(asked, "_pair.input").alias("input"), "_pair.output")


def pairs_from_records(records: DataFrame, input_key: str, output_key: str, strict: bool = True) -> DataFrame:
    """One cleaned pair per record, kept only where both sides have text.

    A record that is not an object fails the job, or is left out when `strict` is off.
    """
    raw = F.col("raw")
    kept = _kept(records)
    parsed = records.select(*kept, "raw", J.fields(raw, input_key, output_key).alias("f"))
    if strict:
        ok = J.is_object(raw)
        parsed = parsed.withColumn("raw", F.when(ok, raw).otherwise(F.raise_error(F.concat(F.lit("record is not an object: "), raw))))
    sides = settled(
        parsed,
        [*kept, F.lit(0).alias("pos")],
        clean(J.printed(raw, F.col("f")[input_key], input_key)).alias("input"),
        clean(J.printed(raw, F.col("f")[output_key], output_key)).alias("output"),
    )
    return sides.filter("input <> '' AND output <> ''")


def _adjacent(said: str, prefix: str, who: str, text: str, humans: list[str], models: list[str]) -> Column:
    """Pairs of neighbours spoken by a human and then the model; the answer must have text.

    `said` and `prefix` name columns: an array read element by element has to be one, or it
    would be parsed again for every element.
    """

    def pair(m: Column, i: Column) -> Column:
        after = F.get(said, i + 1)
        asked = F.when(F.col(prefix) != "", F.concat(prefix, F.lit("\n"), m[text])).otherwise(m[text])
        spoken = m[who].isin(humans) & after[who].isin(models)
        return F.when(spoken, _pair(i, strip(asked), strip(after[text])))

    return F.filter(F.transform(said, pair), lambda p: p["output"] != "")


def _prefix_of_messages(raw: Column) -> Column:
    """`system`, else `system_prompt`; a list stands for its first text, other types for ''."""
    f = J.fields(raw, "system", "system_prompt")

    def one(key: str) -> tuple[Column, Column]:
        text = f[key]
        empty = text.isNull() | text.isin("", "[]", "{}") | (
            text.isin("0", "0.0", "-0.0", "false") & ~J.is_text(raw, text, key)
        )
        first = F.get(J.list_under(raw, key), F.lit(0))
        first_kind = F.schema_of_variant(F.variant_get(F.try_parse_json(text), "$[0]", "variant"))
        in_list = F.when(J.kind_under(raw, key).startswith("ARRAY") & (first_kind == "STRING"), first)
        value = F.when(J.is_text(raw, text, key), text).otherwise(in_list)
        return empty, or_empty(value)

    empty, value = one("system")
    other_empty, other = one("system_prompt")
    return F.when(~empty, value).when(~other_empty, other).otherwise("")


def with_messages(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds `_messages`, `(role, content)` objects, and `_messages_prefix`."""
    said = J.with_objects(records, "_messages", "messages", plain=("role",), parts=("content",), raw=raw)
    return said.withColumn("_messages_prefix", _prefix_of_messages(F.col(raw)))


def _message_pairs() -> Column:
    return _adjacent("_messages", "_messages_prefix", "role", "content", ["user"], ["assistant"])


def pairs_from_messages(records: DataFrame) -> DataFrame:
    """Pairs of `{messages: [{role, content}]}` records; each stands alone, without history."""
    return _exploded(with_messages(records), _kept(records), _message_pairs())


def with_sharegpt(records: DataFrame, parts: bool = False, raw: str = "raw") -> DataFrame:
    """Adds `_sharegpt`, `(from, text)` objects, `content` standing in for a missing `value`, and `_sharegpt_prefix`."""
    texts = ("value", "content")
    said = J.with_objects(records, "_both", "conversations", plain=("from",), raw=raw, there="_found", **{"parts" if parts else "shown": texts})
    raws = J.list_under(F.col(raw), "conversations")
    # A blank `value` beside a `content` is the one case that needs to know whether the field is there.
    unsure = F.exists("_both", lambda m: (m["value"] == "") & (m["content"] != ""))
    there = F.when(unsure, F.coalesce(F.col("_found"), F.transform(raws, lambda e: J.has_field(e, "value"))))
    marked = said.withColumn("_there", there)

    def one(m: Column, i: Column) -> Column:
        text = F.when((m["value"] == "") & ~F.coalesce(F.get("_there", i), F.lit(True)), m["content"]).otherwise(m["value"])
        return F.when(m.isNotNull(), F.struct(m["from"].alias("from"), text.alias("text")))

    system = J.fields(F.col(raw), "system")["system"]
    prefix = F.when(J.is_text(F.col(raw), system, "system"), system).otherwise("")
    return marked.withColumn("_sharegpt", F.transform("_both", one)).withColumn("_sharegpt_prefix", prefix).drop("_both", "_there", "_found")


def _sharegpt_pairs(speakers: Speakers) -> Column:
    return _adjacent("_sharegpt", "_sharegpt_prefix", "from", "text", list(speakers.humans), list(speakers.models))


def pairs_from_sharegpt(records: DataFrame, speakers: Speakers = SPEAKERS) -> DataFrame:
    """Pairs of `{conversations: [{from, value}]}` records."""
    return _exploded(with_sharegpt(records), _kept(records), _sharegpt_pairs(speakers))


def system_of(raw: Column) -> Column:
    """The stripped `system` text of a record, null when blank."""
    return blank_to_null(strip(J.fields(raw, "system")["system"]))


def with_turns(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds `_said`, `(human, assistant)` objects, `_turns`, the stripped `(pos, human, assistant)` turns with text on both sides, and `_system`."""
    said = J.with_objects(records, "_said", "conversation", plain=("human", "assistant"), raw=raw)

    def turn(t: Column, i: Column) -> Column:
        return F.struct(i.alias("pos"), strip(t["human"]).alias("human"), strip(t["assistant"]).alias("assistant"))

    both = F.filter(F.transform("_said", turn), lambda t: (t["human"] != "") & (t["assistant"] != ""))
    return said.withColumn("_turns", both).withColumn("_system", system_of(F.col(raw)))


_BLOCK = 64  # turns whose lengths are summed at once


def _with_told(parsed: DataFrame, max_chars: int | None) -> DataFrame:
    """Adds `_told`, all turns as one text, and `_lengths` and `_sums`, which say where each begins in it."""

    def line(t: Column) -> Column:
        return F.concat(t["human"], F.lit("\n"), t["assistant"])

    # A turn adds at least 4 characters, which bounds how many can be within the limit.
    first = F.col("_turns") if max_chars is None else F.slice("_turns", 1, max_chars // 4 + 1)
    told = F.array_join(F.transform(first, line), "\n")
    lengths = F.transform("_turns", lambda t: (F.length(t["human"]) + F.length(t["assistant"]) + 2).cast("bigint"))
    with_lengths = parsed.withColumn("_told", told if max_chars is None else F.substring(told, 1, max_chars)).withColumn("_lengths", lengths)
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size("_lengths") - 1, F.lit(0)) / _BLOCK).cast("int"))
    return with_lengths.withColumn("_sums", F.transform(blocks, lambda b: _sum(F.slice("_lengths", b * _BLOCK + 1, F.lit(_BLOCK)))))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda total, n: total + n)


def _turn_pairs() -> Column:
    """Pairs of `_turns`, with the length of the turns told before each."""

    def pair(t: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        before = _sum(F.slice("_sums", F.lit(1), block)) + _sum(F.slice("_lengths", block * _BLOCK + 1, i % _BLOCK))
        return _pair(t["pos"], t["human"], t["assistant"], F.greatest(before - 1, F.lit(0).cast("bigint")))

    return F.transform("_turns", pair)


def pairs_from_turns(records: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Pairs of `{system, conversation: [{human, assistant}]}` records, history in front.

    A turn with a blank side is dropped and stays out of later history. `max_chars` keeps
    only that much of each input: exact for samples of at most that many ids, and it keeps
    the work on a long record linear. The turns of a record are one text, of which every
    pair takes its beginning when it becomes a row.
    """
    return _exploded_with_history(_with_told(with_turns(records), max_chars), _kept(records), _turn_pairs(), max_chars)


def turns_corpus(records: DataFrame) -> DataFrame:
    """Texts `(text, n_ids)` with exactly the characters of `pairs_from_turns`, each turn once.

    A newline is among them only if some input has a system text or an earlier turn in front.
    `n_ids` is the length of the record's longest uncut sample, that of its last pair.
    """
    parsed = with_turns(records)
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["human"], F.lit(" "), t["assistant"])), " ")
    newline = F.when(F.col("_system").isNotNull() | (F.size("_turns") > 1), "\n").otherwise("")
    whole = F.concat(or_empty(F.col("_system")), newline, said)
    some = F.size("_turns") > 0
    told = _sum(F.transform("_turns", lambda t: (F.length(t["human"]) + F.length(t["assistant"]) + 2).cast("bigint")))
    n_ids = F.coalesce(F.length("_system") + 1, F.lit(0)) + told + 2
    return parsed.select(F.when(some, whole).otherwise("").alias("text"), F.when(some, n_ids).alias("n_ids"))


def pairs_of_layout(records: DataFrame, layout: str, keys: tuple[str, str] | None = None, max_chars: int | None = None, speakers: Speakers = SPEAKERS) -> DataFrame:
    """Pairs of a corpus whose layout (and, if paired, fields) are known."""
    if layout == L.TURNS:
        return pairs_from_turns(records, max_chars)
    if layout == L.MESSAGES:
        return pairs_from_messages(records)
    if layout == L.SHAREGPT:
        return pairs_from_sharegpt(records, speakers)
    return pairs_from_records(records, *keys)


def sides_of_first(records: DataFrame, first: str, **candidates) -> tuple[str, tuple[str, str]]:
    """The layout of a corpus and the names of its two sides, decided by its first record."""
    layout = L.layout_of_text(records.sparkSession, first)
    if layout == L.PAIRED:
        return layout, L.keys_of_text(first, **candidates)
    name = {L.TURNS: "conversation", L.MESSAGES: "messages", L.SHAREGPT: "conversations"}[layout]
    return layout, (name, name)


def load_pairs(records: DataFrame, max_chars: int | None = None, first: str | None = None, speakers: Speakers = SPEAKERS, **candidates) -> tuple[DataFrame, str, str]:
    """Pairs of a corpus and the names of its two sides, decided by its first record.

    Pass `first` where it is known, or all records are looked through for it. `candidates`
    are those of `layout.choose_keys`.
    """
    layout, names = sides_of_first(records, first or assert_records(records), **candidates)
    return pairs_of_layout(records, layout, names, max_chars, speakers), *names


def observed_pairs(records: DataFrame, layout: str, keys: tuple[str, str], seen: Observation, max_chars: int | None = None, speakers: Speakers = SPEAKERS) -> DataFrame:
    """`pairs_of_layout`, and what became of the elements of records, counted while the pairs are made.

    `seen` has a count per reason of `record_drop_reasons` once the pairs have been written.
    """
    kept = _kept(records)
    if layout == L.TURNS:
        reasons = F.transform("_said", lambda t: _sides_reason(strip(t["human"]), strip(t["assistant"])))
        parsed = _observed(with_turns(records), reasons, seen)
        return _exploded_with_history(_with_told(parsed, max_chars), kept, _turn_pairs(), max_chars)
    if layout == L.MESSAGES:
        parsed = with_messages(records)
        return _exploded(_observed(parsed, _list_reasons("_messages", "role", "content", ["user"], ["assistant"]), seen), kept, _message_pairs())
    if layout == L.SHAREGPT:
        parsed = with_sharegpt(records)
        reasons = _list_reasons("_sharegpt", "from", "text", list(speakers.humans), list(speakers.models))
        return _exploded(_observed(parsed, reasons, seen), kept, _sharegpt_pairs(speakers))
    # A column, or the record would be parsed again for every look at a side.
    parsed = records.withColumn("_fields", J.fields(F.col("raw"), *keys))
    reason = _single_reason(F.col("raw"), keys, F.col("_fields"))
    return pairs_from_records(_observed(parsed, F.array(reason), seen).drop("_fields"), *keys)


REASONS = ["paired", "last", "not_asked", "not_answered", "blank_answer", "blank_side", "not_an_object", "empty"]


def _observed(parsed: DataFrame, reasons: Column, seen: Observation) -> DataFrame:
    some = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("empty")))
    counted = parsed.withColumn("_reasons", some)
    counts = [F.sum(F.size(F.filter("_reasons", _equal_to(r)))).alias(r) for r in REASONS]
    return counted.observe(seen, *counts).drop("_reasons")


def _equal_to(reason: str) -> Callable[[Column], Column]:
    return lambda x: x == reason


def pairs_of_mixed(records: DataFrame, keys: tuple[str, str], max_chars: int | None = None, speakers: Speakers = SPEAKERS) -> DataFrame:
    """Pairs of a corpus in which every record is read by its own layout, kept as `layout`; one scan."""
    kept = [*_kept(records), "layout"]
    parsed = with_messages(L.by_layout(records), L.RAW[L.MESSAGES])
    parsed = with_turns(with_sharegpt(parsed, raw=L.RAW[L.SHAREGPT]), L.RAW[L.TURNS])
    raw = F.col(L.RAW[L.PAIRED])
    sides = [clean(J.printed(raw, J.fields(raw, *keys)[key], key)) for key in keys]
    single = F.filter(F.array(_pair(F.lit(0), *sides)), lambda p: (p["input"] != "") & (p["output"] != ""))
    pairs = (
        F.when(F.col("layout") == L.TURNS, _turn_pairs())
        .when(F.col("layout") == L.MESSAGES, _message_pairs())
        .when(F.col("layout") == L.SHAREGPT, _sharegpt_pairs(speakers))
        .otherwise(single)
    )
    return _exploded_with_history(_with_told(parsed, max_chars), kept, pairs, max_chars)


def _list_reasons(said: str, who: str, text: str, humans: list[str], models: list[str]) -> Column:
    """What became of every element of a list of messages."""

    def reason(m: Column, i: Column) -> Column:
        after = F.get(said, i + 1)
        return (
            F.when(i + 1 == F.size(said), "last")
            .when(~F.coalesce(m[who].isin(humans), F.lit(False)), "not_asked")
            .when(~F.coalesce(after[who].isin(models), F.lit(False)), "not_answered")
            .when(F.coalesce(strip(after[text]), F.lit("")) == "", "blank_answer")
            .otherwise("paired")
        )

    return F.transform(said, reason)


def _sides_reason(one: Column, other: Column) -> Column:
    blank = (F.coalesce(one, F.lit("")) == "") | (F.coalesce(other, F.lit("")) == "")
    return F.when(blank, "blank_side").otherwise("paired")


def _single_reason(raw: Column, keys: tuple[str, str], fields: Column | None = None) -> Column:
    fields = J.fields(raw, *keys) if fields is None else fields
    sides = [clean(J.printed(raw, fields[key], key)) for key in keys]
    return F.when(J.is_object(raw), _sides_reason(*sides)).otherwise("not_an_object")


def record_drop_reasons(records: DataFrame, keys: tuple[str, str], speakers: Speakers = SPEAKERS) -> DataFrame:
    """`(layout, reason, n)`: what became of every message, turn or record, each read by its own layout.

    Counted are elements of lists, and records of one pair; a list without elements counts
    once, as `empty`.
    """
    parsed = with_sharegpt(with_messages(L.by_layout(records), L.RAW[L.MESSAGES]), raw=L.RAW[L.SHAREGPT])
    parsed = J.with_objects(parsed, "_said", "conversation", plain=("human", "assistant"), raw=L.RAW[L.TURNS])
    reasons = (
        F.when(F.col("layout") == L.TURNS, F.transform("_said", lambda t: _sides_reason(strip(t["human"]), strip(t["assistant"]))))
        .when(F.col("layout") == L.MESSAGES, _list_reasons("_messages", "role", "content", ["user"], ["assistant"]))
        .when(F.col("layout") == L.SHAREGPT, _list_reasons("_sharegpt", "from", "text", list(speakers.humans), list(speakers.models)))
        .otherwise(F.array(_single_reason(F.col(L.RAW[L.PAIRED]), keys)))
    )
    some = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("empty")))
    return each_value(parsed, ["layout"], some, "reason").groupBy("layout", "reason").agg(F.count("*").alias("n"))
