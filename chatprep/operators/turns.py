"""Pairs from row-per-turn tables `(conv_id, turn, role, text)`.

One conversation may hold any share of the rows, so nothing here gathers a conversation.
Turns are cut into chunks of `chunk_turns` positions; windows run inside `(conv_id, chunk)`,
a unit of bounded size that hashes evenly, and the little that crosses chunks (the next
chunk's first turn, the system text, history so far) comes from one row per chunk. Only
conversations longer than a chunk need those rows; where there are none, which one look at
the `turn` column tells, the plan is a single shuffle.

Order of work matters. A frame hash-partitioned by `conv_id` alone also counts as clustered
by `(conv_id, chunk)`, and Spark would then run the windows on it as it is, hot conversation
included. Hence every step on turns goes by `(conv_id, chunk)` from the scan onwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from chatprep.functions.rows import each_value
from chatprep.functions.text import blank_to_null, join_lines, or_empty, strip
from chatprep.sources.shared import pinned

CHUNK_TURNS = 4096
# Chunks of long conversations up to this many are broadcast: about 3 MB of keys.
BROADCAST_UNITS = 100_000

_UNIT = ["conv_id", "chunk"]

def _in_chunk() -> WindowSpec:
    return W.partitionBy(*_UNIT).orderBy("turn")


def _before_in_chunk() -> WindowSpec:
    return _in_chunk().rowsBetween(W.unboundedPreceding, -1)


def _chunks_before() -> WindowSpec:
    """Over one row per chunk of a long conversation."""
    return W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)


class _ChunkedTurns:
    """A turn table in chunks, with the chunks of its long conversations."""

    def __init__(self, turns: DataFrame, chunk_turns: int):
        self.rows = self._cut(turns, chunk_turns)
        beyond = (F.col("turn") >= chunk_turns) | (F.col("turn") < 0)
        later = self._cut(turns.filter(beyond).select("conv_id", "turn"), chunk_turns)
        with_first = F.explode(F.array(F.lit(0).cast("bigint"), F.col("chunk")))
        self.carried = None
        self.any_long = not later.isEmpty()
        if self.any_long:
            units = later.select(*_UNIT).distinct().select("conv_id", with_first.alias("chunk")).distinct()
            self._long = pinned(units)
            if self._long.limit(BROADCAST_UNITS + 1).count() <= BROADCAST_UNITS:
                self._long = F.broadcast(self._long)
            # One row per chunk, needed again and again: computed once.
            self.edges = pinned(_chunk_edges(self.long_rows()))

    @staticmethod
    def _cut(turns: DataFrame, chunk_turns: int) -> DataFrame:
        # Rounded down: a negative turn is not in the chunk of turn 0.
        return turns.withColumn("chunk", F.expr(f"CAST((turn - pmod(turn, {chunk_turns})) div {chunk_turns} AS BIGINT)"))

    def places(self) -> DataFrame:
        """`(conv_id, chunk, place, n_places)`: the chunks of long conversations by number, keys alone."""
        of_one = W.partitionBy("conv_id")
        numbered = self.edges.select(*_UNIT, F.row_number().over(of_one.orderBy("chunk")).alias("place"), F.count("*").over(of_one).alias("n_places"))
        return pinned(numbered.select(*_UNIT, F.col("place").cast("bigint").alias("place"), "n_places"))

    def long_rows(self) -> DataFrame:
        """The turns of long conversations, picked before anything is computed on them."""
        return self.rows.join(self._long, _UNIT, "left_semi")


def _in_context(chunks: _ChunkedTurns, turns: DataFrame) -> DataFrame:
    whole = _in_chunk().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    text_if_system = F.when(F.col("role") == "system", F.col("text"))
    rows = turns.select(
        *_UNIT,
        "turn",
        "role",
        "text",
        # Plain columns: a struct here would be shuffled beside the columns it is made of.
        F.lead("role").over(_in_chunk()).alias("next_role"),
        F.lead("text").over(_in_chunk()).alias("next_text"),
        F.first(text_if_system, ignorenulls=True).over(whole).alias("system"),
    )
    if not chunks.any_long:
        return rows
    last = F.lead("turn").over(_in_chunk()).isNull()
    joined = rows.withColumn("last", last).join(chunks.edges, _UNIT, "left")
    return joined.select(
        *_UNIT,
        "turn",
        "role",
        "text",
        F.when(F.col("last"), F.col("follower")["role"]).otherwise(F.col("next_role")).alias("next_role"),
        F.when(F.col("last"), F.col("follower")["text"]).otherwise(F.col("next_text")).alias("next_text"),
        F.coalesce("conv_system", "system").alias("system"),
    )


def _chunk_edges(long_rows: DataFrame) -> DataFrame:
    """Per chunk of a long conversation: the turn that follows it and the conversation's system text."""
    per_chunk = long_rows.groupBy(*_UNIT).agg(
        F.min_by(F.struct("role", "text"), "turn").alias("head"),
        F.min(F.when(F.col("role") == "system", F.struct("turn", "text"))).alias("sys"),
    )
    chunks_of_one = W.partitionBy("conv_id")
    return per_chunk.select(
        *_UNIT,
        F.lead("head").over(chunks_of_one.orderBy("chunk")).alias("follower"),
        F.min("sys").over(chunks_of_one)["text"].alias("conv_system"),
    )


def turns_in_context(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """Every turn with the turn after it and its conversation's system text.

    `(conv_id, turn, role, text, next_role, next_text, system)`; the system text is that of
    the conversation's first `system` turn, as it stands, null where there is none.
    """
    chunks = _ChunkedTurns(turns, chunk_turns)
    return _in_context(chunks, chunks.rows).drop("chunk")


def adjacent_pairs(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """`(conv_id, turn, input, output)`: a user turn and the assistant turn right after it.

    The system text goes in front of every input; an input may be blank, an output not.
    """
    found = turns_in_context(turns, chunk_turns).filter("role = 'user' AND next_role = 'assistant'")
    asked = F.when(F.col("system") != "", join_lines(F.col("system"), F.col("text"))).otherwise(F.col("text"))
    return found.select(
        "conv_id", "turn", strip(asked).alias("input"), strip(F.col("next_text")).alias("output")
    ).filter("output <> ''")


def _kept(chunks: _ChunkedTurns, turns: DataFrame) -> DataFrame:
    """Exchanges `(conv_id, chunk, turn, system, human, assistant)` with text on both sides, stripped."""
    found = _in_context(chunks, turns).filter("role = 'user' AND next_role = 'assistant'")
    return found.select(
        *_UNIT,
        "turn",
        blank_to_null(strip(F.col("system"))).alias("system"),
        strip(F.col("text")).alias("human"),
        strip(F.col("next_text")).alias("assistant"),
    ).filter("human <> '' AND assistant <> ''")


def _exchanges(chunks: _ChunkedTurns, turns: DataFrame) -> DataFrame:
    """Kept exchanges without history, and the length of the text that precedes each.

    Adds `in_chunk`, `carried` and `chars_before`: the lengths of earlier exchanges with
    their newlines, within the chunk, in earlier chunks, and in all.
    """
    size = F.length("human") + F.length("assistant") + F.lit(2).cast("bigint")
    rows = _kept(chunks, turns).withColumn("in_chunk", F.coalesce(F.sum(size).over(_before_in_chunk()), F.lit(0)))
    if chunks.any_long:
        if chunks.carried is None:
            sizes = _kept(chunks, chunks.long_rows()).groupBy(*_UNIT).agg(F.sum(size).alias("chars"))
            chunks.carried = pinned(sizes.select(*_UNIT, F.sum("chars").over(_chunks_before()).alias("carried")))
        rows = rows.join(chunks.carried, _UNIT, "left").withColumn("carried", F.coalesce("carried", F.lit(0)))
    else:
        rows = rows.withColumn("carried", F.lit(0))
    return rows.withColumn("chars_before", F.col("in_chunk") + F.col("carried"))


def base_pairs(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """Kept exchanges `(conv_id, turn, system, human, assistant, chars_before)`, history only counted."""
    chunks = _ChunkedTurns(turns, chunk_turns)
    return _exchanges(chunks, chunks.rows).select(
        "conv_id", "turn", "system", "human", "assistant", "chars_before"
    )


def history_pairs(turns: DataFrame, max_chars: int | None = None, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """`(conv_id, turn, input, output, input_chars)`: exchanges with their history in front.

    An input is the system text, all earlier exchanges and the user's turn, one per line;
    `input_chars` is its full length. With `max_chars` only that much of each input is
    built, which is all a sample of `max_chars` ids can hold: exchanges that start beyond
    it add nothing, so a conversation of any length costs at most `max_chars` per row.
    Without it every row holds its whole history, as long as the data says.
    """
    chunks = _ChunkedTurns(turns, chunk_turns)
    rows = _exchanges(chunks, chunks.rows)

    def cut(text: Column) -> Column:
        return text if max_chars is None else F.substring(text, 1, max_chars)

    def near(offset: str) -> Column:
        return F.lit(True) if max_chars is None else F.col(offset) < max_chars

    exchange = cut(F.concat("human", F.lit("\n"), "assistant"))
    told = F.array_join(F.collect_list(F.when(near("chars_before"), exchange)).over(_before_in_chunk()), "\n")
    out = rows.withColumn("told", blank_to_null(cut(told)))
    if chunks.any_long:
        # One text per chunk; its first exchange is always near its start, so none is missing.
        ordered = F.array_sort(F.collect_list(F.struct("turn", exchange.alias("t"))))
        per_chunk = _exchanges(chunks, chunks.long_rows()).filter(near("in_chunk")).groupBy(*_UNIT).agg(
            cut(F.array_join(F.transform(ordered, lambda p: p["t"]), "\n")).alias("chunk_told"),
            F.first("carried").alias("carried"),
        )
        carried = _told_before(chunks, per_chunk) if max_chars is None else _told_before_cut(per_chunk, max_chars)
        out = out.join(carried, _UNIT, "left")
    else:
        out = out.withColumn("carried_told", F.lit(None).cast("string"))

    system = F.col("system")
    full = F.coalesce(F.length(system) + 1, F.lit(0)) + F.col("chars_before") + F.length("human")
    return out.select(
        "conv_id",
        "turn",
        cut(join_lines(system, F.col("carried_told"), F.col("told"), F.col("human"))).alias("input"),
        F.col("assistant").alias("output"),
        full.cast("bigint").alias("input_chars"),
    )


def _told_before(chunks: _ChunkedTurns, per_chunk: DataFrame) -> DataFrame:
    """`(conv_id, chunk, carried_told)`: all that was told before a chunk, put together where it is needed.

    A chunk's text goes to every later chunk of its conversation, under that chunk's own key:
    texts leave from as many tasks as there are chunks and meet in as many, and no task
    gathers a conversation but for the one whose rows each hold it.
    """
    placed = per_chunk.join(chunks.places(), _UNIT).filter(F.col("place") < F.col("n_places"))
    later = F.explode(F.sequence(F.col("place") + 1, F.col("n_places")))
    sent = placed.select("conv_id", later.alias("place"), F.struct("chunk", F.col("chunk_told").alias("told")).alias("part"))
    ordered = F.transform(F.array_sort(F.collect_list("part")), lambda p: p["told"])
    told = sent.groupBy("conv_id", "place").agg(F.array_join(ordered, "\n").alias("carried_told"))
    return told.join(chunks.places().drop("n_places"), ["conv_id", "place"]).select(*_UNIT, "carried_told")


def _told_before_cut(per_chunk: DataFrame, max_chars: int) -> DataFrame:
    """As `_told_before`, no further than `max_chars`: one text per conversation, of which each chunk takes its part."""
    near = F.struct("chunk", "carried", F.when(F.col("carried") < max_chars, F.col("chunk_told")).alias("told"))
    whole = per_chunk.groupBy("conv_id").agg(F.array_sort(F.collect_list(near)).alias("parts")).select(
        "conv_id",
        F.substring(F.array_join(F.transform("parts", lambda p: p["told"]), "\n"), 1, max_chars).alias("whole"),
        F.transform("parts", lambda p: F.struct(p["chunk"].alias("chunk"), p["carried"].alias("carried"))).alias("places"),
    )
    placed = each_value(whole, ["conv_id", "whole"], "places", "at")
    before = F.substring("whole", F.lit(1), F.greatest(F.col("at.carried") - 1, F.lit(0)).cast("int"))
    return placed.select("conv_id", "at.chunk", blank_to_null(before).alias("carried_told"))


def pair_corpus(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """Texts `(text)` with exactly the characters of all history pairs, in linear size.

    Histories only repeat exchanges, so the exchanges themselves, the blank that joins the
    two sides, and a newline wherever something stands in front of the user's turn suffice.
    """
    led = F.col("system").isNull() & (F.col("chars_before") == 0)
    newline = F.when(led, "").otherwise("\n")
    return base_pairs(turns, chunk_turns).select(
        F.concat(or_empty(F.col("system")), newline, "human", F.lit(" "), "assistant").alias("text")
    )


def drop_reasons(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """`(reason, n_turns)`: what became of every turn, counted instead of skipped in silence."""
    rows = turns_in_context(turns, chunk_turns)
    blank = (strip(F.col("text")) == "") | (strip(F.col("next_text")) == "")
    reason = (
        F.when(F.col("role") == "system", "system")
        .when(F.col("role") != "user", "answer")
        .when(F.col("next_role").isNull(), "user_last")
        .when(F.col("next_role") != "assistant", "user_not_answered")
        .when(blank, "blank_side")
        .otherwise("paired")
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n_turns"))
