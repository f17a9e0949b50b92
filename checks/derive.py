"""Inputs the given tables do not hold as such, made from them row by row.

Chat records come from the lines of documents: one record per document, nothing gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.functions.rows import each
from chatprep.operators.vocab import Codec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_lines(documents: DataFrame) -> DataFrame:
    """Lines as a column: inside a lambda a split would run again for every element."""
    return documents.withColumn("lines", F.split("text", "\n"))


def _lines() -> Column:
    return F.col("lines")


def message_raw() -> Column:
    """A `messages` record. Lines alternate between user and assistant; every fifth length makes a system line."""

    def message(line: Column, i: Column) -> Column:
        alternate = F.when(i % 2 == 0, "user").otherwise("assistant")
        role = F.when(F.length(line) % 5 == 0, "system").otherwise(alternate)
        return F.struct(role.alias("role"), line.alias("content"))

    return F.to_json(F.struct(F.col("source").alias("system"), F.transform(_lines(), message).alias("messages")))


def sharegpt_raw() -> Column:
    """A `conversations` record: as `message_raw`, with other speaker names; a third of the texts sit under `content`."""

    def message(line: Column, i: Column) -> Column:
        human = F.when(F.length(line) % 2 == 0, "human").otherwise("user")
        model = F.element_at(F.array(*[F.lit(n) for n in ("gpt", "model", "chatbot", "bot")]), F.length(line) % 4 + 1)
        elsewhere = F.length(line) % 3 == 0
        return F.struct(
            F.when(i % 2 == 0, human).otherwise(model).alias("from"),
            F.when(~elsewhere, line).alias("value"),
            F.when(elsewhere, line).alias("content"),
        )

    return F.to_json(F.struct(F.col("lang").alias("system"), F.transform(_lines(), message).alias("conversations")))


def turn_raw() -> Column:
    """A `conversation` record. Lines two by two are a turn; a side whose length divides by 7 is left blank."""
    line = _lines()

    def side(i: Column) -> Column:
        text = F.coalesce(F.get(line, i), F.lit(""))
        return F.when(F.length(text) % 7 == 0, " ").otherwise(text)

    def turn(i: Column) -> Column:
        return F.struct(side(i * 2).alias("human"), side(i * 2 + 1).alias("assistant"))

    count = F.ceil(F.size(line) / 2).cast("int")
    turns = F.transform(F.sequence(F.lit(0), count - 1), turn)
    system = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.col("source")))
    return F.to_json(F.struct(system.alias("system"), turns.alias("conversation")))


def text_raw() -> Column:
    """A paired record. The first line, quoted and padded, asks; the rest answers. `response` is decoy text."""
    asked = F.concat(F.lit(' 　"'), F.get(_lines(), F.lit(0)), F.lit("\"' "))
    rest = F.array_join(F.slice(_lines(), F.lit(2), F.greatest(F.size(_lines()), F.lit(1))), "\n")
    return F.to_json(F.struct("doc_id", F.col("lang").alias("response"), rest.alias("output"), asked.alias("prompt")))


def number_records(events: DataFrame) -> DataFrame:
    """Records whose sides are a number and a nested object."""
    raw = F.concat(
        F.lit('{"value": '), F.col("value").cast("string"), F.lit(', "user": '), F.col("user_id").cast("string"),
        F.lit(', "flag": true, "question": null}'),
    )
    return events.select(F.col("event_id").alias("rec_id"), raw.alias("raw"))


def mixed_raw() -> Column:
    """Each document in one of four layouts, by its id."""
    kind = F.col("doc_id") % 4
    return (
        F.when(kind == 0, message_raw()).when(kind == 1, sharegpt_raw()).when(kind == 2, turn_raw()).otherwise(text_raw())
    )


def records(documents: DataFrame, raw: Column) -> DataFrame:
    return with_lines(documents).select(F.col("doc_id").alias("rec_id"), raw.alias("raw"))


def json_documents(documents: DataFrame) -> DataFrame:
    """Each document as a JSON text: a list, `data`, some other list, or a bare object, by its id."""
    line = F.transform(_lines(), lambda text, i: F.struct(i.alias("instruction"), text.alias("output")))
    kind = F.col("doc_id") % 4
    doc = (
        F.when(kind == 0, F.to_json(line))
        .when(kind == 1, F.to_json(F.struct(F.lit(1).alias("meta"), F.array(F.lit(7)).alias("rows"), line.alias("data"))))
        .when(kind == 2, F.to_json(F.struct(F.lit("[").alias("meta"), line.alias("rows"), F.array(F.lit(7)).alias("other"))))
        .otherwise(F.to_json(F.struct(F.col("doc_id").alias("instruction"), F.col("text").alias("output"))))
    )
    return with_lines(documents).select("doc_id", doc.alias("value"))


def json_files(documents: DataFrame) -> DataFrame:
    """`(source, value)`: lines of one JSON document per source, in order: a list, `data`, or some other list.

    The first record is blank, so that every other one follows a comma.
    """
    kind = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(3))
    blank = F.lit('{"instruction": "", "output": ""}')
    head = (
        F.when(kind == 0, F.lit("["))
        .when(kind == 1, F.lit('{"meta": {"a": [1, "]"], "b": "[\\\\"}, "rows": [7], "data": ['))
        .otherwise(F.lit('{"meta": "[\\"", "rows": ['))
    )
    foot = F.when(kind == 0, F.lit("]")).when(kind == 1, F.lit('], "more": [1, {"x": [2]}]}')).otherwise(F.lit('], "other": [{"instruction": 7, "output": 7}]}'))
    record = F.to_json(F.struct(F.col("doc_id").alias("instruction"), F.col("text").alias("output")))
    sources = documents.select("source").distinct().withColumn("doc_id", F.lit(None).cast("bigint"))
    rows = documents.select("source", "doc_id", F.lit(1).alias("at"), F.concat(F.lit(", "), record).alias("value"))
    rows = rows.unionByName(sources.select("source", "doc_id", F.lit(0).alias("at"), F.concat(head, blank).alias("value")))
    rows = rows.unionByName(sources.select("source", "doc_id", F.lit(2).alias("at"), foot.alias("value")))
    ordered = rows.repartition("source").sortWithinPartitions("source", "at", "doc_id")
    return ordered.select("source", "value")


def answer_tokens(conversations: DataFrame, codec: Codec) -> DataFrame:
    """Tokens of every answer with begin and end ids: a generation each; after the end of every third answer more tokens follow."""
    answers = conversations.filter("role = 'assistant'")
    beyond = F.when(F.col("turn") % 3 == 0, codec.encode(F.col("text"))).otherwise(F.array().cast("array<int>"))
    rows = each(answers, ["conv_id", "turn"], F.concat(codec.encode(F.col("text")), beyond), "step", "token_id")
    return rows.select("conv_id", "turn", "step", "token_id")


def event_scores(events: DataFrame) -> DataFrame:
    """Events as candidates of their user, scored by rounded value so that ties occur."""
    return events.select(
        F.col("user_id").alias("ctx_id"), F.col("event_id").alias("token_id"), F.round("value", 0).alias("score")
    )


def event_steps(events: DataFrame) -> DataFrame:
    """Events as training steps of their user, one epoch per day; views stand for validation."""
    return events.select(
        F.col("user_id").alias("run_id"),
        F.dayofmonth("ts").cast("bigint").alias("epoch"),
        F.col("event_id").alias("step"),
        F.when(F.col("event_type") == "view", "val").otherwise("train").alias("split"),
        F.col("value").alias("loss"),
        F.when(F.col("event_type") != "view", F.lit(1.0) / (F.col("event_id") + 1)).alias("lr"),
        (F.col("event_id") % 7 + 1).cast("double").alias("seconds"),
        (F.col("event_id") % 100).alias("n_tokens"),
    )


def event_epochs(events: DataFrame) -> DataFrame:
    """Mean value per user and day as a validation loss."""
    return events.groupBy(F.col("user_id").alias("run_id"), F.dayofmonth("ts").cast("bigint").alias("epoch")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("bigint")) / F.count("*") / 100.0).alias("val_loss")
    )


def label_pieces(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors as source pieces of characters, by their label: one piece each, some used twice; some also of a special id."""
    ids = F.array(
        F.col("label") + 4,
        F.when(F.col("vec_id") % 7 == 0, F.col("label") + 4),
        F.when(F.col("vec_id") % 5 == 0, F.col("label") % 4),
    )
    pieces = embeddings.select(F.posexplode(ids).alias("piece_pos", "id"), F.col("vec_id").alias("source_id")).filter("id IS NOT NULL")
    return pieces.select("id", "piece_pos", "source_id"), embeddings.select(F.col("vec_id").alias("source_id"), F.col("embedding").alias("vec"))
