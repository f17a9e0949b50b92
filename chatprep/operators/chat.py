"""Chat messages, templates, truncation and packing: the fine-tuning data path."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatprep.constants import PAD_ID
from chatprep.functions import jsonvals as J
from chatprep.functions.rows import each, each_value
from chatprep.functions.text import or_empty, strip
from chatprep.operators import layout as L
from chatprep.operators.batching import pad_batches
from chatprep.operators.pairs import SPEAKERS, Speakers, with_messages, with_sharegpt
from chatprep.operators.packing import packed
from chatprep.operators.ranks import ordered_rank, shuffled_rank
from chatprep.operators.vocab import Codec

IGNORED_LABEL = -100


def _message(role, content: Column) -> Column:
    who = role if isinstance(role, Column) else F.lit(role)
    return F.struct(who.alias("role"), content.alias("content"))


def _first_system(raw: Column) -> Column:
    system = strip(or_empty(J.fields(raw, "system")["system"]))
    none = F.array().cast("array<struct<role: string, content: string>>")
    return F.when(system != "", F.array(_message("system", system))).otherwise(none)


def _of_turns(turns: Column) -> Column:
    stripped = F.transform(turns, lambda t: F.struct(strip(t["human"]).alias("human"), strip(t["assistant"]).alias("assistant")))
    said = F.filter(stripped, lambda t: (t["human"] != "") | (t["assistant"] != ""))
    both = F.transform(said, lambda t: F.array(_message("user", t["human"]), _message("assistant", t["assistant"])))
    return F.flatten(both)


def _of_speakers(said: Column, who: str, text: str, speakers: Speakers) -> Column:
    def message(m: Column) -> Column:
        role = F.when(m[who].isin(list(speakers.humans)), "user").when(m[who].isin(list(speakers.models)), "assistant").otherwise(m[who])
        return _message(role, m[text])

    return F.transform(F.filter(said, lambda m: m.isNotNull()), message)


def _of_pair(raw: Column, entries: Column, keys: Column) -> Column:
    def side(name: str, at: int) -> Column:
        key = F.when(F.array_contains(keys, name), F.lit(name)).otherwise(F.try_element_at(keys, F.lit(at)))
        value = F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]
        truth = value.isin("true", "false") & (F.schema_of_variant(J.kinds(raw)[key]) == "BOOLEAN")
        return F.when(value.isNull(), "None").when(truth, F.initcap(value)).otherwise(value)

    return F.array(_message("user", side("instruction", 1)), _message("assistant", side("output", -1)))


def chat_messages(records: DataFrame, speakers: Speakers = SPEAKERS) -> DataFrame:
    """Adds `messages`, one array of `(role, content)` per record, in place of the raw text.

    Turns give an optional system message and both sides of every turn that has any text;
    message lists keep their roles under common names; other records give `instruction` or
    the first field as the user and `output` or the last field as the assistant.
    """
    raw = F.col("raw")
    kept = [c for c in records.columns if c != "raw"]
    pair = F.col(L.RAW[L.PAIRED])
    parsed = J.with_objects(L.by_layout(records), "_turns", "conversation", shown=("human", "assistant"), raw=L.RAW[L.TURNS])
    parsed = with_sharegpt(with_messages(parsed, L.RAW[L.MESSAGES]), parts=True, raw=L.RAW[L.SHAREGPT])
    parsed = parsed.withColumn("_entries", F.map_entries(F.from_json(pair, "map<string,string>"))).withColumn("_keys", J.keys_of(pair))
    messages = (
        F.when(F.col("layout") == L.TURNS, F.concat(_first_system(raw), _of_turns(F.col("_turns"))))
        .when(F.col("layout") == L.MESSAGES, F.concat(_first_system(raw), _of_speakers(F.col("_messages"), "role", "content", speakers)))
        .when(F.col("layout") == L.SHAREGPT, F.concat(_first_system(raw), _of_speakers(F.col("_sharegpt"), "from", "text", speakers)))
        .otherwise(_of_pair(pair, F.col("_entries"), F.col("_keys")))
    )
    return parsed.select(*kept, messages.alias("messages"))


@dataclass(frozen=True)
class ChatTemplate:
    """What stands before and after a message of a role; `{role}` is the role's name."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    by_role: dict = field(default_factory=dict)
    answer_cue: str = "<|im_start|>assistant\n"

    def render(self, role: Column, content: Column) -> Column:
        def around(pattern: str) -> Column:
            head, found, tail = pattern.partition("{role}")
            return F.concat(F.lit(head), role, F.lit(tail)) if found else F.lit(pattern)

        text = F.concat(around(self.before), content, around(self.after))
        for name, (before, after) in self.by_role.items():
            text = F.when(role == name, F.concat(F.lit(before), content, F.lit(after))).otherwise(text)
        return text


CHATML = ChatTemplate()


def render_chat(messages: Column, template: ChatTemplate = CHATML, generation_prompt: bool = False) -> Column:
    """The text of an array of messages, ending with the cue to answer if asked."""
    parts = F.transform(messages, lambda m: template.render(m["role"], m["content"]))
    cue = F.lit(template.answer_cue if generation_prompt else "")
    return F.concat(F.array_join(parts, ""), cue)


def render_turns(turns: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """Row-per-turn tables: each turn's share of the rendered text, as `piece`.

    A conversation's text is its pieces in turn order; it is never put together in one row.
    """
    piece = template.render(F.col("role"), F.col("text"))
    return turns.select("conv_id", "turn", piece.alias("piece"))


def tokenize_truncate(df: DataFrame, codec: Codec, text: str = "text", max_len: int = 512) -> DataFrame:
    """Adds `ids`: at most the first `max_len` ids of the text, no padding."""
    ids = codec.encode(F.substring(F.col(text), 1, max_len), add_special=False)
    return df.withColumn("ids", ids)


def pack(
    df: DataFrame,
    order: list[str],
    ids: Column,
    n_ids: Column | None = None,
    max_len: int = 512,
    rows_per_group: int | None = 1000,
    unit: list[str] | None = None,
) -> DataFrame:
    """`(group_id, block_id, ids)`: ids of consecutive rows joined and cut into blocks.

    Every `rows_per_group` rows in the order of the unique `order` columns form a group, or
    all rows of so many of a `unit`, e.g. the turns of 1000 conversations; a
    group's ids are joined without a separator and what does not fill a last block is left
    out, unless the group is shorter than one block, which is then kept short. With no
    group size the whole table is one group.

    What rows hold moves once, by range of the order (`packing`). `n_ids` gives the number of
    ids without making them, `ids` makes them after the move; without it ids are made once
    and move themselves, so that no tokenizer runs twice. Where both are given, `ids` must
    depend on nothing but the row.
    """
    if n_ids is None:
        df = df.select(*order, ids.alias("_ids"))
        ids, n_ids = F.col("_ids"), F.size("_ids")
    return packed(df, order, ids, n_ids, max_len, rows_per_group, unit, text=False).withColumnRenamed("part", "ids")


def pack_text(
    df: DataFrame, order: list[str], codec: Codec, text: str = "text", max_len: int = 512, rows_per_group: int | None = 1000
) -> DataFrame:
    """`pack` of a text column under the character vocabulary, without begin and end ids.

    One character is one id, so texts are moved and cut as they are, a quarter of the bytes
    of their ids, and encoded block by block.
    """
    blocks = packed(df.select(*order, text), order, F.col(text), F.length(text), max_len, rows_per_group, None, text=True)
    return blocks.select("group_id", "block_id", codec.encode(F.col("part"), add_special=False).alias("ids"))


def labels_of(ids: Column, pad_id: int = PAD_ID) -> Column:
    """What a language model is to predict: the ids, -100 wherever they hold the pad id."""
    return F.transform(ids, lambda i: F.when(i == pad_id, IGNORED_LABEL).otherwise(i))


def lm_collate(batches: DataFrame, pad_id: int = PAD_ID) -> DataFrame:
    """Pads `ids` to the longest of their batch and adds `labels`, made of the padded ids so that ids alone move."""
    padded = pad_batches(batches, ("ids",), (pad_id,))
    return padded.withColumn("labels", labels_of(F.col("ids"), pad_id))


def pack_efficiency(
    df: DataFrame, order: list[str], n_ids: Column, max_len: int = 512, rows_per_group: int = 1000, batch_rows: int = 16, seed: int = 42
) -> DataFrame:
    """One row comparing padded batches of cut rows with packed blocks, from lengths alone.

    `(n_rows, real_ids, cut_ids, padded_cells, packed_cells, packed_ids, dropped_ids)`.
    """
    sized = df.select(*order, n_ids.cast("bigint").alias("n"))
    short = F.least(F.col("n"), F.lit(max_len))
    batch = F.floor((F.col("rank") - 1) / batch_rows)
    batches = shuffled_rank(sized, order, seed).groupBy(batch.alias("b")).agg(
        F.count("*").alias("rows"), F.sum("n").alias("real"), F.sum(short).alias("cut"), F.max(short).alias("width")
    )
    padded = batches.agg(
        F.sum("rows").alias("n_rows"),
        F.sum("real").alias("real_ids"),
        F.sum("cut").alias("cut_ids"),
        F.sum(F.col("rows") * F.col("width")).alias("padded_cells"),
    )
    group = F.floor(F.col("rank") / rows_per_group)
    totals = ordered_rank(sized, order).groupBy(group.alias("g")).agg(F.sum("n").alias("total"))
    kept = F.when(F.col("total") >= max_len, F.floor(F.col("total") / max_len) * max_len).otherwise(F.col("total"))
    packed = totals.agg(F.sum(kept).alias("packed_ids"), F.sum(F.col("total") - kept).alias("dropped_ids"))
    # Two one-row tables.
    sides = padded.withColumn("one", F.lit(1)).join(packed.withColumn("one", F.lit(1)), "one").drop("one")
    return sides.select(
        "n_rows", "real_ids", "cut_ids", "padded_cells", F.col("packed_ids").alias("packed_cells"), "packed_ids", "dropped_ids"
    )
