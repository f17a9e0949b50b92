"""Chat context and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatprep.constants import BOS_ID
from chatprep.functions.text import clean_keep_inner_space, strip
from chatprep.operators.vocab import Codec


# Spark cuts a row-number filter per task up to this many rows (its own default).
_TOP_K_PER_TASK = 1000
_SLICES = 64


def is_system() -> Column:
    return F.coalesce(F.col("role") == "system", F.lit(False))


def _newest(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    at = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("turn")))
    return rows.withColumn("_n", at).filter(F.col("_n") <= k).drop("_n")


def context_window(history: DataFrame, n: int) -> DataFrame:
    """The messages that go with a new prompt: adds `section`, to be read in `(section, turn)` order.

    A history of at most `2n` messages stays whole and in order (section 1). A longer one
    keeps all system messages, moved in front (section 0), and the last `2n` others. `n=0`
    keeps everything.

    The row-number filter is a top-k Spark applies per task before the shuffle, and only
    system messages need to know how long their conversation is; no conversation is gathered.
    """
    if n <= 0:
        return history.withColumn("section", F.lit(1))
    others = history.filter(~is_system())
    if 2 * n > _TOP_K_PER_TASK:
        # Too many for Spark to cut per task: first the newest of slices of a conversation.
        sliced = others.withColumn("_slice", F.pmod(F.col("turn"), F.lit(_SLICES)))
        others = _newest(sliced, ["conv_id", "_slice"], 2 * n).drop("_slice")
    others = _newest(others, ["conv_id"], 2 * n)
    sizes = history.groupBy("conv_id").agg(F.count("*").alias("_n"))
    system = history.filter(is_system()).join(sizes, "conv_id")
    front = F.when(F.col("_n") > 2 * n, 0).otherwise(1)
    return others.withColumn("section", F.lit(1)).unionByName(system.withColumn("section", front).drop("_n"))


def normalize_history(exchanges: DataFrame, prompts: DataFrame) -> DataFrame:
    """Messages of `(conv_id, pos, user, assistant)` exchanges, then of `(conv_id, prompt)`.

    `(conv_id, is_prompt, pos, slot, role, content)`, in the order of `is_prompt, pos, slot`;
    an exchange without an answer gives its user message only.
    """
    said = F.array(
        F.struct(F.lit(0).alias("slot"), F.lit("user").alias("role"), F.col("user").alias("content")),
        F.struct(F.lit(1).alias("slot"), F.lit("assistant").alias("role"), F.col("assistant").alias("content")),
    )
    kept = F.filter(said, lambda m: (m["slot"] == 0) | (m["content"] != ""))
    past = exchanges.select("conv_id", F.lit(False).alias("is_prompt"), F.col("pos").cast("bigint").alias("pos"), F.inline(kept))
    asked = prompts.select(
        "conv_id",
        F.lit(True).alias("is_prompt"),
        F.lit(0).cast("bigint").alias("pos"),
        F.lit(0).alias("slot"),
        F.lit("user").alias("role"),
        clean_keep_inner_space(F.col("prompt")).alias("content"),
    )
    return past.unionByName(asked)


def prompt_text(text: Column, system: Column) -> Column:
    """User text under its system text, both stripped; no system text if null or ''."""
    alone = strip(text)
    below = strip(F.concat(strip(system), F.lit("\n"), alone))
    return F.when(F.coalesce(system, F.lit("")) != "", below).otherwise(alone)


def prompt_ids(codec: Codec, text: Column, system: Column) -> Column:
    """Ids a model continues from: the encoded prompt and the begin id of its answer."""
    return F.array_append(codec.encode(prompt_text(text, system)), F.lit(BOS_ID))


def prompt_limit(block_size: int, max_new: int = 256) -> int:
    return max(8, block_size - max_new - 4)


def truncate_prompt(ids: Column, block_size: int, max_new: int = 256, keep: str = "start") -> Column:
    """As many ids as leave room for `max_new` more; what is cut is the end, or with `keep="ends"` the middle."""
    limit = prompt_limit(block_size, max_new)
    start = F.slice(ids, 1, limit)
    if keep == "start":
        return start
    tail = limit - limit // 2
    ends = F.concat(F.slice(ids, 1, limit // 2), F.slice(ids, F.greatest(F.size(ids) - tail + 1, F.lit(1)), F.lit(tail)))
    return F.when(F.size(ids) > limit, ends).otherwise(start)


def build_prompts(df: DataFrame, codec: Codec, block_size: int, max_new: int = 256, keep: str = "start") -> DataFrame:
    """Adds `ids`, the cut prompt of `text` under `system`; unreachable text is not encoded."""
    limit = prompt_limit(block_size, max_new)
    text = prompt_text(F.col("text"), F.col("system"))
    n_full = F.length(text) + 3
    reached = F.substring(text, 1, limit) if keep == "start" else text
    ids = truncate_prompt(F.array_append(codec.encode(reached), F.lit(BOS_ID)), block_size, max_new, keep)
    return df.withColumn("n_full", n_full).withColumn("ids", ids)
