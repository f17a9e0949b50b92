"""The three ways through the operators, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chatprep.constants import BLOCK_SIZES, MAX_BLOCK, MIN_BLOCK, N_SPECIAL, UNK_ID
from chatprep.operators import batching, chat, context, embeddings, layout, pairs, samples, turns, vocab
from chatprep.sources import records as R
from chatprep.sources.shared import stored


def open_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a `.jsonl` corpus, or of JSON documents."""
    return R.read_jsonl(spark, path) if path.rstrip("/*").endswith(".jsonl") else R.read_json(spark, path)


def open_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """`open_records` and the first record, looked for in the first file that has one and in no other."""
    records = open_records(spark, path)
    if path.rstrip("/*").endswith(".jsonl"):
        return records, R.first_line(spark, path)
    return records, R.first_of_documents(spark, path)


@dataclass(frozen=True)
class TrainingSet:
    """Samples with their split, the vocabulary behind them, and the shared system text.

    The samples are a stored table: the split and every epoch's batches read them again. There
    is no vocabulary table where a codec was given.
    """

    samples: DataFrame
    vocabulary: DataFrame | None
    codec: vocab.Codec
    system: str | None = None


def training_set_from_records(
    records: DataFrame, size: str = "small", eval_ratio: float = 0.0, first: str | None = None, block_size: int | None = None, **split
) -> TrainingSet:
    """Records of any layout to split samples; `first` is the first record where it is known.

    `block_size` overrides that of the size, e.g. with what `samples.length_profile` calls for.
    """
    block = block_size or BLOCK_SIZES[size]
    first = first or R.assert_records(records)
    cut, _, _ = pairs.load_pairs(records, block, first)
    # Only turn records repeat text in their inputs; their vocabulary is read off the turns.
    has_history = layout.layout_of_text(records.sparkSession, first) == layout.TURNS
    vocabulary = vocab.build_vocab(pairs.turns_corpus(records) if has_history else vocab.pair_text(cut))
    codec = vocab.Codec.of(vocabulary)
    made = stored(samples.make_samples(cut, codec, block), "samples")
    system = layout.uniform_system(records).first()["system"]
    return TrainingSet(batching.train_val_split(made, ["rec_id", "pos"], eval_ratio, **split), vocabulary, codec, system)


@dataclass(frozen=True)
class Corpus:
    """A training set and what was seen while it was made.

    `reasons` counts what became of the elements of records (`pairs.record_drop_reasons`),
    `longest` is the longest sample before any was cut, null if a vocabulary was given;
    `n_unknown` counts ids of characters that the vocabulary lacks.
    """

    training: TrainingSet
    layout: str
    keys: tuple[str, str]
    block_size: int
    longest: int | None
    n_records: int
    n_samples: int
    n_unknown: int
    reasons: dict[str, int]

    def summary(self) -> DataFrame:
        """One row: `n_pairs`, the two sides' names, and the start of the shared system text."""
        system = self.training.system
        row = (self.n_samples, *self.keys, system[:40] + "..." if system else None)
        return self.training.samples.sparkSession.createDataFrame([row], "n_pairs long, input_key string, output_key string, system_excerpt string")


def load_corpus(
    records: DataFrame, size: str = "small", eval_ratio: float = 0.0, first: str | None = None, adapt: bool = False,
    codec: vocab.Codec | None = None, speakers: pairs.Speakers = pairs.SPEAKERS, **split,
) -> Corpus:
    """Records of any layout to split samples and all that is told about them, in two scans of the corpus.

    The first makes the vocabulary and sees the longest sample; it is left out if a `codec` is
    given. The second writes the samples, and counts records, drop reasons and unknown
    characters and compares system texts as they pass. With `adapt` blocks are as long as
    the longest sample asks for, up to the largest block there is.
    """
    first = first or R.assert_records(records)
    kind, keys = pairs.sides_of_first(records, first)
    block, longest = BLOCK_SIZES[size], None
    vocabulary = None
    if codec is None:
        seen = Observation("lengths")
        if kind == layout.TURNS:
            texts = pairs.turns_corpus(records)
        else:
            whole = pairs.pairs_of_layout(records, kind, keys, speakers=speakers)
            n_ids = (F.length("input") + F.length("output") + 4).cast("bigint")
            texts = vocab.pair_text(whole.withColumn("n_ids", n_ids), "n_ids")
        vocabulary = stored(vocab.build_vocab(texts.observe(seen, F.max("n_ids").alias("longest"))), "vocabulary")
        codec = vocab.Codec.of(vocabulary)
        # A pair has a blank at least; where nothing is paired Spark may have left out the counting.
        longest = seen.get["longest"] if codec.size > N_SPECIAL else None
        if adapt:
            block = max(block, min(max(longest or 0, MIN_BLOCK), MAX_BLOCK))
    system, reasons, made = Observation("system"), Observation("reasons"), Observation("samples")
    read = layout.observed_system(records, system)
    cut = pairs.observed_pairs(read, kind, keys, reasons, block, speakers)
    unknown = F.size("ids") - F.size(F.array_remove("ids", UNK_ID))
    rows = samples.make_samples(cut, codec, block, arrow=True).observe(made, F.count("*").alias("n"), F.sum(unknown).alias("unknown"))
    kept = stored(rows, "samples")
    told = {r: n for r, n in reasons.get.items() if n}
    training = TrainingSet(batching.train_val_split(kept, ["rec_id", "pos"], eval_ratio, **split), vocabulary, codec, layout.system_seen(system.get))
    return Corpus(training, kind, keys, block, longest, system.get["n_records"], made.get["n"], made.get["unknown"] or 0, told)


def training_set_from_turns(
    table: DataFrame, size: str = "small", eval_ratio: float = 0.0, block_size: int | None = None, **split
) -> TrainingSet:
    """Row-per-turn conversations to split samples, history in front of every input."""
    block = block_size or BLOCK_SIZES[size]
    vocabulary = vocab.build_vocab(turns.pair_corpus(table))
    codec = vocab.Codec.of(vocabulary)
    made = stored(samples.make_samples(turns.history_pairs(table, max_chars=block), codec, block), "samples")
    return TrainingSet(batching.train_val_split(made, ["conv_id", "turn"], eval_ratio, **split), vocabulary, codec)


def epoch_batches(
    prepared: DataFrame, keys: list[str], split: str, epoch: int, batch_rows: int = 16, size: str = "small"
) -> DataFrame:
    """Padded batches of one epoch, no larger than the size allows; only training drops a short last batch."""
    batch_rows = batching.batch_rows_for(size, batch_rows)
    part = prepared.filter(F.col("split") == split).drop("split")
    return batching.padded_batches(part, keys, epoch, batch_rows, drop_last=split == "train")


def finetune_blocks(
    records: DataFrame, ids: Column, n_ids: Column | None = None, max_len: int = 512, packing: bool = True, template: chat.ChatTemplate = chat.CHATML
) -> DataFrame:
    """Records to rendered chats to id rows: packed blocks, or one cut row per record.

    `ids` and `n_ids` are expressions on the rendered column `text`; without `n_ids` ids are
    made once and kept.
    """
    texts = chat.chat_messages(records).select("rec_id", chat.render_chat(F.col("messages"), template).alias("text"))
    if packing:
        return chat.pack(texts, ["rec_id"], ids, n_ids, max_len)
    return texts.select("rec_id", F.slice(ids, 1, max_len).alias("ids"))


def finetune_turns(
    table: DataFrame, ids: Column, n_ids: Column | None = None, max_len: int = 512, conversations: int = 1000, template: chat.ChatTemplate = chat.CHATML
) -> DataFrame:
    """Row-per-turn conversations to packed blocks `(group_id, block_id, ids)`, so many conversations to a group.

    A turn is rendered and tokenized by itself, and a conversation is the ids of its turns
    in order; none is ever put together in a row. `ids` and `n_ids` are expressions on the
    rendered column `piece`.
    """
    pieces = chat.render_turns(table, template)
    return chat.pack(pieces, ["conv_id", "turn"], ids, n_ids, max_len, conversations, ["conv_id"])


def finetune_batches(
    blocks: DataFrame, keys: list[str], eval_ratio: float = 0.05, split: str = "train", epoch: int = 1, batch_rows: int = 2
) -> DataFrame:
    """Rows of `ids` to one epoch's collated batches of a split: `ids` padded, `labels` masked where they are.

    The evaluation rows are an exact share; only training drops a short last batch. Give a
    stored table.
    """
    part = batching.train_val_split(blocks, keys, eval_ratio).filter(F.col("split") == split).drop("split")
    return chat.lm_collate(batching.assign_batches(part, keys, epoch, batch_rows, drop_last=split == "train"))


def initial_embeddings(
    pieces: DataFrame, source: DataFrame, vocabulary: DataFrame, source_dim: int, target_dim: int
) -> DataFrame:
    """`(id, vec)`: pooled source vectors, projected where they are too long, padded where too short, checked."""
    pooled = stored(embeddings.pool_embeddings(pieces, source, vocabulary, source_dim), "pooled")
    fitted = embeddings.svd_project(pooled, "id", "vec", target_dim) if source_dim > target_dim else pooled
    out = stored(embeddings.pad_dims(fitted, target_dim), "embeddings")
    embeddings.assert_embedding_shape(out, vocabulary.count(), target_dim)
    return out


def chat_prompts(history: DataFrame, prompts: DataFrame, n: int, template: chat.ChatTemplate = chat.CHATML) -> DataFrame:
    """Rendered pieces of `(conv_id, prompt)` and their context, in `(part, section, turn)` order.

    The last piece of a conversation ends with the cue to answer.
    """
    past = context.context_window(history, n).select(
        "conv_id", F.lit(0).alias("part"), "section", "turn", template.render(F.col("role"), F.col("text")).alias("piece")
    )
    prompt = context.clean_keep_inner_space(F.col("prompt"))
    asked = prompts.select(
        "conv_id",
        F.lit(1).alias("part"),
        F.lit(1).alias("section"),
        F.lit(0).cast("bigint").alias("turn"),
        F.concat(template.render(F.lit("user"), prompt), F.lit(template.answer_cue)).alias("piece"),
    )
    return past.unionByName(asked)
