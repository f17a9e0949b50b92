"""Every operator as a query on the given tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import derive as D
from checks.derive import table
from chatprep.constants import SPLIT_SEED
from chatprep.functions import jsonvals as J
from chatprep.functions.codec import detokenizer, ids_csv, register_tokenizer, register_tokenizer_spec, tokenizer
from chatprep.functions.rows import each
from chatprep.functions.text import clean, clean_keep_inner_space, excerpt
from chatprep.operators import batching as B
from chatprep.operators import chat as C
from chatprep.operators import context as X
from chatprep.operators import embeddings as E
from chatprep.operators import layout as L
from chatprep.operators import pairs as P
from chatprep.operators import runs as R
from chatprep.operators import samples as S
from chatprep.operators import scores as G
from chatprep.operators import turns as T
from chatprep.operators import vocab as V
from chatprep.plans import prepare
from chatprep.sources import records as Rec
from chatprep.sources import tables as Tab
from chatprep.sources.shared import new_folder, stored
from chatprep.streaming import streams as Z

BLOCK = 256
KEYS = ["conv_id", "turn"]
RATIO = 0.1
SVD_COLUMNS = 8
STREAM_BATCHES = 4
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    return Tab.read_turns(spark, f"{sf}/conversations.parquet")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """The given tables can be a single piece, which one core would read; larger ones stay as they are."""
    documents = table(spark, sf, "documents")
    cores = spark.sparkContext.defaultParallelism
    return documents.repartition(cores) if documents.rdd.getNumPartitions() < cores else documents


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def _vocab(spark: SparkSession, sf: str) -> DataFrame:
    return V.build_vocab(T.pair_corpus(_conversations(spark, sf)))


def _codec(spark: SparkSession, sf: str) -> V.Codec:
    return V.Codec.of(_vocab(spark, sf))


def _samples(spark: SparkSession, sf: str, block: int = BLOCK) -> DataFrame:
    cut = T.history_pairs(_conversations(spark, sf), max_chars=block).drop("input_chars")
    return S.make_samples(cut, _codec(spark, sf), block)


# --- pairs ---------------------------------------------------------------------------


def samples(spark, sf):
    """Flagship: conversations with history to bounded id samples."""
    return _samples(spark, sf).select(*KEYS, F.size("ids").cast("bigint").alias("n_tokens"), ids_csv(F.col("ids")).alias("ids"))


def pairs_adjacent(spark, sf):
    return T.adjacent_pairs(_conversations(spark, sf))


def pairs_history(spark, sf):
    return T.history_pairs(_conversations(spark, sf))


def pairs_history_cut(spark, sf):
    return T.history_pairs(_conversations(spark, sf), max_chars=128)


def pairs_messages_nested(spark, sf):
    return P.pairs_from_messages(D.records(_documents(spark, sf), D.message_raw()))


def pairs_sharegpt_nested(spark, sf):
    return P.pairs_from_sharegpt(D.records(_documents(spark, sf), D.sharegpt_raw()))


def pairs_sharegpt_named(spark, sf):
    """As `pairs_sharegpt_nested`, with speakers of other names."""
    speakers = P.Speakers(humans=("human",), models=("gpt", "bot"))
    return P.pairs_from_sharegpt(D.records(_documents(spark, sf), D.sharegpt_raw()), speakers)


def pairs_turns_nested(spark, sf):
    return P.pairs_from_turns(D.records(_documents(spark, sf), D.turn_raw()))


def pairs_records(spark, sf):
    records = D.records(_documents(spark, sf), D.text_raw())
    return P.pairs_from_records(records, *L.detect_keys(records)).drop("pos")


def pairs_records_numbers(spark, sf):
    records = D.number_records(_events(spark, sf))
    return P.pairs_from_records(records, "value", "flag").select("rec_id", F.col("input").cast("double").alias("number"), "output")


def pairs_mixed(spark, sf):
    return P.pairs_of_mixed(D.records(_documents(spark, sf), D.mixed_raw()), ("prompt", "output"))


def pair_drop_reasons(spark, sf):
    return T.drop_reasons(_conversations(spark, sf))


def record_drop_reasons(spark, sf):
    return P.record_drop_reasons(D.records(_documents(spark, sf), D.mixed_raw()), ("prompt", "output"))


# --- layout and summaries --------------------------------------------------------------


def layouts(spark, sf):
    return D.records(_documents(spark, sf), D.mixed_raw()).select("rec_id", L.layout_of(F.col("raw")).alias("layout"))


def detect_layout(spark, sf):
    """The layout each corpus gets from its first record."""
    docs = _documents(spark, sf)
    raws = {"m": D.message_raw(), "s": D.sharegpt_raw(), "t": D.turn_raw(), "p": D.text_raw()}
    rows = [(name, L.detect_layout(D.records(docs, raw))) for name, raw in raws.items()]
    return spark.createDataFrame(rows, "corpus string, layout string")


def uniform_system(spark, sf):
    docs = _documents(spark, sf)
    mixed = L.uniform_system(D.records(docs, D.message_raw())).select(F.lit("by source").alias("corpus"), "system")
    same = D.records(docs.withColumn("source", F.regexp_replace("source", "[0-9]+$", "")), D.message_raw())
    return mixed.unionByName(L.uniform_system(same).select(F.lit("one name").alias("corpus"), "system"))


def dataset_summary(spark, sf):
    docs = _documents(spark, sf)
    records = D.records(docs, D.text_raw())
    keys = L.detect_keys(records)
    plain = L.dataset_summary(P.pairs_from_records(records, *keys), *keys, L.uniform_system(records).first()["system"])
    led = D.records(docs.withColumn("source", F.lit("one system text of more than forty characters")), D.message_raw())
    pairs, *names = P.load_pairs(led)
    return plain.unionByName(L.dataset_summary(pairs, *names, L.uniform_system(led).first()["system"]))


def preview(spark, sf):
    return L.preview(T.adjacent_pairs(_conversations(spark, sf)), KEYS)


def read_jsonl_fields(spark, sf):
    path = new_folder(spark, "events-jsonl")
    _events(spark, sf).select(F.concat(F.lit("  "), F.col("props"), F.lit("\n")).alias("value")).write.text(path)
    records = Rec.strict_objects(Rec.read_jsonl(spark, path))
    return records.select(J.printed(F.col("raw"), J.fields(F.col("raw"), "k")["k"], "k").alias("k"))


def read_json_documents(spark, sf):
    records = Rec.records_of_documents(D.json_documents(_documents(spark, sf)), "doc_id", "value")
    return P.pairs_from_records(records, "instruction", "output").select(
        F.col("rec_id.doc").alias("doc_id"), F.col("input").cast("bigint").alias("line"), "output"
    )


def read_json_files(spark, sf):
    """One JSON file per source; those of more than 128 kB are read by ranges of that size."""
    path = new_folder(spark, "json-files")
    D.json_files(_documents(spark, sf)).write.partitionBy("source").text(path)
    records = Rec.read_json(spark, path, split_bytes=1 << 17)
    return P.pairs_from_records(records, "instruction", "output").select(F.col("input").cast("bigint").alias("doc_id"), "output")


def corpus_facts(spark, sf):
    """What loading a corpus tells, for one of each layout: counted while vocabulary and samples are made."""
    docs = _documents(spark, sf)
    raws = {"messages": D.message_raw(), "sharegpt": D.sharegpt_raw(), "turns": D.turn_raw(), "paired": D.text_raw()}
    rows = []
    for name, raw in raws.items():
        corpus = prepare.load_corpus(D.records(docs, raw), adapt=True)
        facts = {"n_records": corpus.n_records, "n_samples": corpus.n_samples, "longest": corpus.longest, "block_size": corpus.block_size}
        facts |= {"vocabulary": corpus.training.codec.size, "n_unknown": corpus.n_unknown} | corpus.reasons
        rows += [(name, fact, value) for fact, value in facts.items()]
    return spark.createDataFrame(rows, "corpus string, fact string, value long")


def split_corrupt(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    good, bad = Rec.split_corrupt(_events(spark, sf).select(F.col("event_id").alias("rec_id"), raw.alias("raw")))
    parts = [df.select("rec_id", F.lit(name).alias("part")) for name, df in (("good", good), ("corrupt", bad))]
    return parts[0].unionByName(parts[1])


# --- vocabulary and codec ----------------------------------------------------------------


def vocab(spark, sf):
    return _vocab(spark, sf)


def vocab_size(spark, sf):
    return V.vocab_size(_vocab(spark, sf))


def vocab_round_trip(spark, sf):
    path = new_folder(spark, "vocab")
    Tab.write_vocab(_vocab(spark, sf), path)
    return Tab.vocab_from_json(Tab.vocab_to_json(Tab.read_vocab(spark, path)))


def char_frequency(spark, sf):
    return V.char_frequency(_documents(spark, sf))


def vocab_pruned(spark, sf):
    return V.prune_vocab(V.char_frequency(_documents(spark, sf)), 50)


def oov_report(spark, sf):
    return V.oov_report(_documents(spark, sf), _vocab(spark, sf))


def encode(spark, sf):
    codec = _codec(spark, sf)
    return _documents(spark, sf).select("doc_id", ids_csv(codec.encode(F.col("text"))).alias("ids"))


def encode_joined(spark, sf):
    encoded = V.encode_by_join(_documents(spark, sf), _vocab(spark, sf), ["doc_id"])
    return encoded.select("doc_id", ids_csv(F.col("ids")).alias("ids"))


def encode_arrow(spark, sf):
    encoder = V.arrow_encoder(_codec(spark, sf))
    return _documents(spark, sf).select("doc_id", ids_csv(encoder("text")).alias("ids"))


def encode_plugged(spark, sf):
    """An outside tokenizer: the lengths of blank-separated words stand for its ids."""
    register_tokenizer("word_lengths", lambda texts: texts.map(lambda t: [len(w) for w in t.split(" ")]))
    return _documents(spark, sf).select("doc_id", ids_csv(tokenizer("word_lengths")(F.col("text"))).alias("ids"))


def encode_tokenizer_file(spark, sf):
    """A byte-level tokenizer file loses nothing: its ids, told back, are the text."""
    register_tokenizer_spec("byte_level", "chatprep.functions.codec:tokenizer_file", path=TOKENIZER)
    ids = _documents(spark, sf).select("doc_id", tokenizer("byte_level")(F.col("text")).alias("ids"))
    told = detokenizer("chatprep.functions.codec:detokenizer_file", path=TOKENIZER)
    return ids.select("doc_id", told(F.col("ids")).alias("text"))


def decode_round_trip(spark, sf):
    codec = _codec(spark, sf)
    ids = _documents(spark, sf).select("doc_id", codec.encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", codec.decode(F.col("ids")).alias("text"))


def decode_with_specials(spark, sf):
    codec = _codec(spark, sf)
    ids = _documents(spark, sf).select("doc_id", codec.encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", codec.decode(F.col("ids"), skip_special=False).alias("text"))


# --- samples, split, batches ---------------------------------------------------------------


def shift_targets(spark, sf):
    x, y = ids_csv(F.col("x")).alias("x"), ids_csv(F.col("y")).alias("y")
    return S.shift_targets(_samples(spark, sf)).select(*KEYS, x, y)


def length_profile(spark, sf):
    profile = S.length_profile(T.history_pairs(_conversations(spark, sf), max_chars=1), "large")
    return profile.withColumn("mean", F.round("mean", 6))


def write_samples(spark, sf):
    """Samples with their split, written by split and read back."""
    path = new_folder(spark, "written")
    Tab.write_samples(B.train_val_split(stored(_samples(spark, sf), "samples"), KEYS, RATIO), path)
    return spark.read.parquet(path).select(*KEYS, "split", ids_csv(F.col("ids")).alias("ids"))


def train_val_split(spark, sf):
    return B.train_val_split(_samples(spark, sf).select(*KEYS), KEYS, RATIO)


def _batches(spark, sf):
    return B.assign_batches(S.shift_targets(_samples(spark, sf)), KEYS)


def assign_batches(spark, sf):
    return _batches(spark, sf).select(*KEYS, "epoch", "batch_id", "row_in_batch")


def assign_batches_documents(spark, sf):
    return B.assign_batches(_documents(spark, sf).select("doc_id"), ["doc_id"], epoch=2, drop_last=False)


def pad_batches(spark, sf):
    padded = B.padded_batches(stored(_samples(spark, sf), "samples"), KEYS)
    return padded.select("batch_id", "row_in_batch", ids_csv(F.col("x")).alias("x"), ids_csv(F.col("y")).alias("y"))


def batch_matrices(spark, sf):
    rows = B.batch_matrices(B.padded_batches(stored(_samples(spark, sf), "samples"), KEYS))
    flat = [ids_csv(F.flatten(c)).alias(c) for c in ("x", "y")]
    return rows.select("batch_id", F.size("x").alias("n_rows"), *flat)


def loss_mask(spark, sf):
    masked = S.loss_mask(B.padded_batches(stored(_samples(spark, sf), "samples"), KEYS))
    mask = F.array_join(F.transform("mask", lambda m: m.cast("int").cast("string")), "")
    return masked.select("batch_id", "row_in_batch", "n_counted", mask.alias("mask"))


def batch_plan(spark, sf):
    return B.batch_plan(_samples(spark, sf).select(*KEYS), epochs=3, accum=4)


def lr_schedule(spark, sf):
    rows = _samples(spark, sf).select(*KEYS)
    plan = B.batch_plan(rows, epochs=3, accum=1)
    _, total, warmup = B.plan_sizes(rows.count(), 16, 3, 0.05)
    return B.lr_schedule(plan, total, warmup).withColumn("lr", F.round(F.col("lr") * 1e6, 6))


# --- chat and packing ------------------------------------------------------------------------


def chat_messages(spark, sf):
    chats = C.chat_messages(D.records(_documents(spark, sf), D.turn_raw()))
    return each(chats, ["rec_id"], "messages", "pos", "m").select("rec_id", "pos", "m.role", "m.content")


def chat_messages_lists(spark, sf):
    chats = C.chat_messages(D.records(_documents(spark, sf), D.sharegpt_raw()))
    return each(chats, ["rec_id"], "messages", "pos", "m").select("rec_id", "pos", "m.role", "m.content")


def render_chat(spark, sf):
    chats = C.chat_messages(D.records(_documents(spark, sf), D.text_raw()))
    return chats.select("rec_id", C.render_chat(F.col("messages"), generation_prompt=True).alias("text"))


def render_turns(spark, sf):
    return C.render_turns(_conversations(spark, sf))


def render_roles(spark, sf):
    """A template with texts of its own for some roles."""
    template = C.ChatTemplate("<{role}> ", "\n", {"user": ("[ask] ", "\n"), "assistant": ("[say] ", " [end]\n")})
    return C.render_turns(_conversations(spark, sf), template)


def tokenize_truncate(spark, sf):
    cut = C.tokenize_truncate(_documents(spark, sf), _codec(spark, sf))
    return cut.select("doc_id", F.size("ids").alias("n"), ids_csv(F.col("ids")).alias("ids"))


def pack_blocks(spark, sf):
    packed = C.pack_text(_documents(spark, sf).select("doc_id", "text"), ["doc_id"], _codec(spark, sf), rows_per_group=300)
    return packed.select("group_id", "block_id", ids_csv(F.col("ids")).alias("ids"))


def pack_global(spark, sf):
    codec = _codec(spark, sf)
    packed = C.pack_text(_conversations(spark, sf).select(*KEYS, "text"), KEYS, codec, max_len=1024, rows_per_group=None)
    return packed.select("block_id", ids_csv(F.col("ids")).alias("ids"))


def lm_collate(spark, sf):
    rows = C.tokenize_truncate(_documents(spark, sf), _codec(spark, sf), max_len=64).select("doc_id", "ids")
    collated = C.lm_collate(B.assign_batches(rows, ["doc_id"], batch_rows=4))
    return collated.select("doc_id", ids_csv(F.col("ids")).alias("ids"), ids_csv(F.col("labels")).alias("labels"))


def finetune_turns(spark, sf):
    codec = _codec(spark, sf)
    packed = prepare.finetune_turns(
        _conversations(spark, sf), codec.encode(F.col("piece"), add_special=False), F.length("piece"), max_len=512, conversations=40
    )
    return packed.select("group_id", "block_id", ids_csv(F.col("ids")).alias("ids"))


def finetune_split(spark, sf):
    """Collated batches of both splits; ids come from a tokenizer that runs once."""
    codec = _codec(spark, sf)
    ids = codec.encode(F.col("text"), add_special=False)
    rows = prepare.finetune_blocks(D.records(_documents(spark, sf), D.text_raw()), ids, max_len=48, packing=False)
    rows = stored(rows, "rows")
    parts = [prepare.finetune_batches(rows, ["rec_id"], RATIO, split).withColumn("split", F.lit(split)) for split in ("train", "val")]
    both = parts[0].unionByName(parts[1])
    return both.select("split", "rec_id", "batch_id", "row_in_batch", ids_csv(F.col("ids")).alias("ids"), ids_csv(F.col("labels")).alias("labels"))


def pack_efficiency(spark, sf):
    return C.pack_efficiency(_documents(spark, sf), ["doc_id"], F.length("text"), rows_per_group=300)


# --- context and prompts -----------------------------------------------------------------------


def context_window_n2(spark, sf):
    return X.context_window(_conversations(spark, sf), 2)


def normalize_history(spark, sf):
    turns = T.turns_in_context(_conversations(spark, sf))
    answered = turns.filter("role = 'user' AND next_role = 'assistant'")
    exchanges = answered.select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("user"), F.col("next_text").alias("assistant"))
    prompts = turns.filter("role = 'user' AND next_role IS NULL").select("conv_id", F.col("text").alias("prompt"))
    return X.normalize_history(exchanges, prompts)


def build_prompt(spark, sf):
    asked = T.turns_in_context(_conversations(spark, sf)).filter("role = 'user'")
    ids = X.prompt_ids(_codec(spark, sf), F.col("text"), F.col("system"))
    return asked.select(*KEYS, ids_csv(ids).alias("ids"))


def truncate_prompt(spark, sf):
    asked = T.turns_in_context(_conversations(spark, sf)).filter("role = 'user'").select(*KEYS, "text", "system")
    cut = X.build_prompts(asked, _codec(spark, sf), block_size=512, max_new=256)
    return cut.select(*KEYS, "n_full", ids_csv(F.col("ids")).alias("ids"))


def truncate_prompt_ends(spark, sf):
    asked = T.turns_in_context(_conversations(spark, sf)).filter("role = 'user'").select(*KEYS, "text", "system")
    cut = X.build_prompts(asked, _codec(spark, sf), block_size=361, max_new=256, keep="ends")
    return cut.select(*KEYS, "n_full", ids_csv(F.col("ids")).alias("ids"))


def clean_message(spark, sf):
    quoted = F.concat(F.lit("\t\"'' "), F.col("text"), F.lit(" '\" "))
    rows = _conversations(spark, sf).select(*KEYS, quoted.alias("q"))
    return rows.select(*KEYS, clean(F.col("q")).alias("cleaned"), clean_keep_inner_space(F.col("q")).alias("kept"))


def excerpts(spark, sf):
    return _documents(spark, sf).select("doc_id", excerpt(F.col("text"), 120).alias("head"))


# --- scores -------------------------------------------------------------------------------------


def topk_ties(spark, sf):
    return G.topk_filter(D.event_scores(_events(spark, sf)), 5)


def softmax(spark, sf):
    probs = G.softmax(D.event_scores(_events(spark, sf)), temperature=20.0)
    return probs.select("ctx_id", "token_id", F.round("prob", 9).alias("prob"))


def sample_one(spark, sf):
    probs = G.softmax(G.topk_filter(D.event_scores(_events(spark, sf)), 50), temperature=20.0)
    return G.sample_one(probs, SPLIT_SEED)


def sample_scores(spark, sf):
    return G.sample_scores(G.topk_filter(D.event_scores(_events(spark, sf)), 50), SPLIT_SEED, temperature=20.0)


def nucleus(spark, sf):
    probs = stored(G.softmax(D.event_scores(_events(spark, sf)), temperature=20.0), "probs")
    return G.nucleus_filter(probs, 0.9).select("ctx_id", "token_id")


# --- generations and runs -------------------------------------------------------------------------


def assemble_generation(spark, sf):
    codec = _codec(spark, sf)
    return R.assemble_generation(D.answer_tokens(_conversations(spark, sf), codec), codec, KEYS)


def running_generation(spark, sf):
    codec = _codec(spark, sf)
    grown = R.running_generation(D.answer_tokens(_conversations(spark, sf), codec), codec, KEYS)
    return grown.select(*KEYS, "pos", F.md5("text").alias("text_md5"))


def throughput(spark, sf):
    tokens = _events(spark, sf).select(F.col("user_id").alias("gen_id"), "ts")
    rates = R.throughput(tokens)
    return rates.select("gen_id", "n_tokens", F.round("seconds", 3).alias("seconds"), F.round("tokens_per_sec", 9).alias("tokens_per_sec"))


def epoch_rollup(spark, sf):
    rolled = R.epoch_rollup(D.event_steps(_events(spark, sf)))
    rounded = [F.round(c, 9).alias(c) for c in ("train_loss", "val_loss", "lr", "nominal_tokens_per_sec", "real_tokens_per_sec")]
    return rolled.select("run_id", "epoch", "seconds", "n_steps", *rounded)


def early_stop(spark, sf):
    stops = R.early_stop(D.event_epochs(_events(spark, sf)))
    return stops.withColumn("best_val", F.round("best_val", 9)).withColumn("bad_epochs", F.col("bad_epochs").cast("bigint"))


def best_epoch(spark, sf):
    return R.best_epoch(D.event_epochs(_events(spark, sf))).withColumn("val_loss", F.round("val_loss", 9))


# --- embeddings ------------------------------------------------------------------------------------


def _long(vectors: DataFrame, key: str, digits: int) -> DataFrame:
    return each(vectors, [key], "vec", "dim", "x").select(key, "dim", F.round("x", digits).alias("x"))


def pool_embeddings(spark, sf):
    pieces, source = D.label_pieces(table(spark, sf, "embeddings"))
    return _long(E.pool_embeddings(pieces, source, _vocab(spark, sf), 64), "id", 6)


def initial_embeddings(spark, sf):
    pieces, source = D.label_pieces(table(spark, sf, "embeddings"))
    return _long(prepare.initial_embeddings(pieces, source, _vocab(spark, sf), 64, 80), "id", 6)


def initial_embeddings_projected(spark, sf):
    """Fewer dimensions than the source has, and more than the pooled vectors span: their lengths stay."""
    pieces, source = D.label_pieces(table(spark, sf, "embeddings"))
    made = prepare.initial_embeddings(pieces, source, _vocab(spark, sf), 64, 48)
    energy = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    return made.select("id", F.size("vec").alias("n_dims"), F.round(energy, 6).alias("energy"))


def pad_dims(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return _long(E.pad_dims(vectors, 80), "vec_id", 6)


def svd_energy(spark, sf):
    """Full rank keeps every row's length, whatever the signs of the columns."""
    projected = E.svd_project(table(spark, sf, "embeddings"), "vec_id", "embedding", 64)
    energy = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    return projected.select("vec_id", F.round(energy, 4).alias("energy"))


def svd_columns(spark, sf):
    """Products of the first columns: none between two, and squared lengths that fall and are more than any original column's."""
    vectors = table(spark, sf, "embeddings")
    projected = E.svd_project(vectors, "vec_id", "embedding", SVD_COLUMNS)
    product = [F.sum(F.col("vec")[i] * F.col("vec")[j]).alias(f"p{i}_{j}") for i in range(SVD_COLUMNS) for j in range(i, SVD_COLUMNS)]
    plain = [F.sum(F.col("embedding")[k].cast("double") * F.col("embedding")[k].cast("double")).alias(f"o{k}") for k in range(64)]
    one = F.lit(1).alias("one")
    both = projected.agg(one, *product).join(vectors.agg(one, *plain), "one")  # a row and a row
    most = F.greatest(*[F.col(f"o{k}") for k in range(64)])
    total = reduce(lambda a, b: a + b, [F.col(f"o{k}") for k in range(64)])
    kept = reduce(lambda a, b: a + b, [F.col(f"p{i}_{i}") for i in range(SVD_COLUMNS)])
    tests = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.abs(f"p{i}_{j}") < 1e-6 * F.col("p0_0") if i < j else F.col(f"p{i}_{i}") <= F.col(f"p{i - 1}_{i - 1}" if i else "p0_0")).alias("holds"))
        for i in range(SVD_COLUMNS) for j in range(i, SVD_COLUMNS)
    ]
    whole = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), ((F.col("p0_0") >= most - 1e-9) & (kept <= total + 1e-9) & (kept >= total * SVD_COLUMNS / 64)).alias("holds"))
    return both.select(F.inline(F.array(*tests, whole)))


# --- streams -----------------------------------------------------------------------------------------


def stream_samples(spark, sf):
    docs = _documents(spark, sf)
    path = new_folder(spark, "turn-records")
    tagged = F.concat(F.lit('{"doc_id": '), F.col("rec_id").cast("string"), F.lit(", "), F.expr("substring(raw, 2)"))
    D.records(docs, D.turn_raw()).select(tagged.alias("value")).write.text(path)
    arriving = Rec.stream_jsonl(spark, path)
    records = arriving.select(J.fields(F.col("raw"), "doc_id")["doc_id"].cast("bigint").alias("rec_id"), "raw")
    made = Z.stream_samples(records, L.TURNS, _codec(spark, sf), BLOCK)
    return Z.drain(made, "samples").select("rec_id", "pos", ids_csv(F.col("ids")).alias("ids"))


def _arriving(spark, rows, keys):
    """The rows as files in no order, which arrive in several batches."""
    path = new_folder(spark, "arriving")
    n = max(2 * STREAM_BATCHES, spark.sparkContext.defaultParallelism)
    rows.repartition(n, F.xxhash64(*keys)).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", math.ceil(n / STREAM_BATCHES)).parquet(path)


def stream_context_window(spark, sf):
    arriving = _arriving(spark, _conversations(spark, sf), KEYS)
    history = Z.drain(Z.stream_context_window(arriving, 2), "context")
    return Z.current(history, "conv_id", "version").drop("version", "n_seen")


def stream_early_stop(spark, sf):
    arriving = _arriving(spark, D.event_epochs(_events(spark, sf)), ["run_id", "epoch"])
    states = Z.current(Z.drain(Z.stream_early_stop(arriving), "stops"), "run_id", "version").drop("version", "n_known")
    return states.withColumn("best_val", F.round("best_val", 9)).withColumn("bad_epochs", F.col("bad_epochs").cast("bigint"))


def stream_throughput(spark, sf):
    tokens = _arriving(spark, _events(spark, sf).select("event_id", F.col("event_type").alias("source"), "ts"), ["event_id"])
    rates, _ = Z.drain_updates(Z.stream_throughput(tokens, delay=None), ["source", "window_start"], "throughput")
    start = F.col("window_start").cast("timestamp_ntz").alias("window_start")
    return rates.select("source", start, "n_tokens", F.round("tokens_per_sec", 9).alias("tokens_per_sec"))


QUERIES = [
    samples, pairs_adjacent, pairs_history, pairs_history_cut, pairs_messages_nested, pairs_sharegpt_nested, pairs_sharegpt_named,
    pairs_turns_nested, pairs_records, pairs_records_numbers, pairs_mixed, pair_drop_reasons, record_drop_reasons,
    layouts, detect_layout, uniform_system, dataset_summary, preview, read_jsonl_fields, read_json_documents, read_json_files, corpus_facts, split_corrupt,
    vocab, vocab_size, vocab_round_trip, char_frequency, vocab_pruned, oov_report, encode, encode_joined, encode_arrow, encode_plugged, encode_tokenizer_file,
    decode_round_trip, decode_with_specials,
    shift_targets, length_profile, write_samples, train_val_split, assign_batches, assign_batches_documents, pad_batches,
    batch_matrices, loss_mask, batch_plan, lr_schedule,
    chat_messages, chat_messages_lists, render_chat, render_turns, render_roles, tokenize_truncate, pack_blocks, pack_global,
    lm_collate, finetune_turns, finetune_split, pack_efficiency,
    context_window_n2, normalize_history, build_prompt, truncate_prompt, truncate_prompt_ends, clean_message, excerpts,
    topk_ties, softmax, sample_one, sample_scores, nucleus,
    assemble_generation, running_generation, throughput, epoch_rollup, early_stop, best_epoch,
    pool_embeddings, initial_embeddings, initial_embeddings_projected, pad_dims, svd_energy, svd_columns,
    stream_samples, stream_context_window, stream_early_stop, stream_throughput,
]
