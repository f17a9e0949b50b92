"""Which layout a corpus has, which fields hold the two sides, and short summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chatprep.constants import INPUT_CANDIDATES, OUTPUT_CANDIDATES
from chatprep.functions import jsonvals as J
from chatprep.functions.text import excerpt
from chatprep.sources.records import CorpusError, assert_records

TURNS, MESSAGES, SHAREGPT, PAIRED = "turns", "messages", "sharegpt", "paired"


# Columns that hold a record's text if it has that layout, and null otherwise.
RAW = {layout: f"_raw_{layout}" for layout in (TURNS, MESSAGES, SHAREGPT, PAIRED)}


def layout_of(raw: Column, keys: Column | None = None) -> Column:
    """Layout of one record: `conversation`, `messages`, `conversations` lists, else paired.

    `keys`, the names of its fields where they are at hand, spare a record the look into
    lists that it does not have.
    """

    def has_list(key: str) -> Column:
        listed = J.list_under(raw, key).isNotNull()
        return listed if keys is None else F.when(F.array_contains(keys, key), listed).otherwise(False)

    return F.when(has_list("conversation"), TURNS).when(has_list("messages"), MESSAGES).when(has_list("conversations"), SHAREGPT).otherwise(PAIRED)


def by_layout(records: DataFrame) -> DataFrame:
    """Adds `layout` and the columns of `RAW`: parsers of other layouts find nothing to parse."""
    named = records.withColumn("_names", J.keys_of(F.col("raw")))
    marked = named.withColumn("layout", layout_of(F.col("raw"), F.col("_names"))).drop("_names")
    texts = {column: F.when(F.col("layout") == layout, F.col("raw")) for layout, column in RAW.items()}
    return marked.withColumns(texts)


def layout_of_text(spark: SparkSession, raw: str) -> str:
    return spark.createDataFrame([(raw,)], "raw string").select(layout_of(F.col("raw"))).first()[0]


def detect_layout(records: DataFrame) -> str:
    """Layout of the first record, which stands for the corpus."""
    return layout_of_text(records.sparkSession, assert_records(records))


def choose_keys(
    keys: list[str],
    input_candidates: list[str] = INPUT_CANDIDATES,
    output_candidates: list[str] = OUTPUT_CANDIDATES,
) -> tuple[str, str]:
    """The input and output field among one record's names, candidates before position."""
    if len(keys) < 2:
        raise CorpusError(f"a record needs at least 2 fields, got {keys}")
    found_in = next((name for name in input_candidates if name in keys), None)
    found_out = next((name for name in output_candidates if name in keys and name != found_in), None)
    rest = [name for name in keys if name not in (found_in, found_out)] or keys
    chosen = (found_in or rest[0], found_out or rest[-1])
    if chosen[0] == chosen[1]:
        raise CorpusError(f"cannot tell input from output among {keys}")
    return chosen


def keys_of_text(raw: str, **candidates) -> tuple[str, str]:
    first = json.loads(raw)
    if not isinstance(first, dict):
        raise CorpusError("record 0 is not an object")
    return choose_keys(list(first), **candidates)


def detect_keys(records: DataFrame, **candidates) -> tuple[str, str]:
    """Field names of the first record's two sides."""
    return keys_of_text(assert_records(records), **candidates)


def uniform_system(records: DataFrame) -> DataFrame:
    """One row `(system)`: the text all object records share; a missing field counts as ''.

    Nulls ahead of the first text do not matter; a null after it, any difference, a blank
    text and a record that does not parse make it null. One combinable aggregate over one
    pass: all texts are equal where the least is the greatest.
    """
    facts = _marked(records).agg(*_system_facts())
    nulls_lead = F.col("last_null").isNull() | (F.col("last_null") < F.col("first_text"))
    same = (F.col("lo") == F.col("hi")) & nulls_lead & (F.col("lo") != "") & ~F.col("broken")
    return facts.select(F.when(same, F.col("lo")).alias("system"))


def _marked(records: DataFrame) -> DataFrame:
    raw = F.col("raw")
    text = J.fields(raw, "system")["system"]
    told = F.when(J.has_field(raw, "system"), text).otherwise("")
    broken = ~J.is_object(raw) & J.root_kind(raw).isNull()
    return records.withColumns({"_system_text": told, "_object": J.is_object(raw), "_broken": broken})


def _system_facts() -> list[Column]:
    said, at = F.when(F.col("_object"), F.col("_system_text")), F.col("rec_id")
    return [
        F.min(said).alias("lo"),
        F.max(said).alias("hi"),
        F.min(F.when(said.isNotNull(), at)).alias("first_text"),
        F.max(F.when(F.col("_object") & said.isNull(), at)).alias("last_null"),
        F.coalesce(F.bool_or("_broken"), F.lit(False)).alias("broken"),
    ]


def observed_system(records: DataFrame, seen: Observation) -> DataFrame:
    """The records as they are; `seen` has what `system_seen` asks for once they have been read through."""
    marked = _marked(records).observe(seen, F.count("*").alias("n_records"), *_system_facts())
    return marked.select(*records.columns)


def system_seen(facts: dict) -> str | None:
    """`uniform_system` from what was observed."""
    nulls_lead = facts["last_null"] is None or (facts["first_text"] is not None and facts["last_null"] < facts["first_text"])
    same = facts["lo"] is not None and facts["lo"] == facts["hi"] and nulls_lead and not facts["broken"]
    return (facts["lo"] or None) if same else None


def dataset_summary(pairs: DataFrame, input_key: str, output_key: str, system: str | None = None) -> DataFrame:
    """Pair count, the chosen fields and the start of the shared system text."""
    shown = F.lit(system[:40] + "..." if system else None).cast("string")
    return pairs.agg(
        F.count("*").alias("n_pairs"),
    ).select("n_pairs", F.lit(input_key).alias("input_key"), F.lit(output_key).alias("output_key"), shown.alias("system_excerpt"))


def preview(pairs: DataFrame, order: list[str], n: int = 2, width: int = 120) -> DataFrame:
    """The first `n` pairs, both sides cut at `width` characters."""
    top = pairs.orderBy(*order).limit(n)
    return top.select(*order, excerpt(F.col("input"), width).alias("input"), excerpt(F.col("output"), width).alias("output"))
