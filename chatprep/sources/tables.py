"""Row-per-turn tables, vocabularies and samples as stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.constants import MAX_CODE_POINTS
from chatprep.sources.records import CorpusError

TURN_COLUMNS = ["conv_id", "turn", "role", "text"]


def read_turns(spark: SparkSession, path) -> DataFrame:
    """Chat turns `(conv_id, turn, role, text)`; `turn` counts from 0 within a conversation."""
    return spark.read.parquet(path).select(*TURN_COLUMNS)


def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.select("ch", "id").write.mode("overwrite").parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("ch", "id")


def vocab_to_json(vocab: DataFrame) -> DataFrame:
    """One row `(state)`: `{stoi: {ch: id}, itos: {"id": ch}}`, bounded by Unicode."""
    entries = F.array_sort(F.collect_list(F.struct("id", "ch")))
    stoi = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["ch"], e["id"])))
    itos = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["id"].cast("string"), e["ch"])))
    return vocab.agg(F.to_json(F.struct(stoi.alias("stoi"), itos.alias("itos"))).alias("state"))


def vocab_from_json(state: DataFrame) -> DataFrame:
    """Vocabulary rows of a stored `{stoi, itos}` text (column `state`)."""
    itos = F.from_json("state", "struct<itos: map<string,string>>")["itos"]
    return state.select(F.explode(itos).alias("id", "ch")).select("ch", F.col("id").cast("int").alias("id"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples as Parquet, one folder per split when there is one."""
    writer = samples.write.mode("overwrite")
    if "split" in samples.columns:
        writer = writer.partitionBy("split")
    writer.parquet(path)


def assert_vocab_size(size: int) -> None:
    if size > MAX_CODE_POINTS + 4:
        raise CorpusError(f"a character vocabulary cannot have {size} rows")
