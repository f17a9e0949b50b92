"""JSON and JSONL corpora as `(rec_id, raw)`, and the guards on them."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.functions import jsonvals as J
from chatprep.functions.rows import each
from chatprep.functions.text import strip
from chatprep.sources import jsondocs


class CorpusError(ValueError):
    """The corpus cannot be read as conversation records."""


def read_jsonl(spark: SparkSession, path) -> DataFrame:
    """One record per non-blank line, as `(rec_id, raw)` in file order."""
    return _ordered_lines(spark.read.text(path), strip(F.col("value")))


def stream_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files as they arrive; `raw` only, since arrival has no total order."""
    return spark.readStream.text(path).select(strip(F.col("value")).alias("raw")).filter("raw <> ''")


def _ordered_lines(lines: DataFrame, text: Column) -> DataFrame:
    # File and split offset make the order independent of how splits were packed into tasks.
    rec_id = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return lines.select(rec_id.alias("rec_id"), text.alias("raw")).filter("raw <> ''")


def read_json(spark: SparkSession, path, split_bytes: int = jsondocs.SPLIT_BYTES) -> DataFrame:
    """Files that each hold one JSON document: a list, a wrapped list, or one object.

    Files of up to `split_bytes` are a row of text each, so many of them scale. Larger ones
    are read by byte ranges of that size (`jsondocs`), wherever `pyarrow.fs` can open them.
    """
    small = read_json_whole(spark, path, split_bytes)
    if jsondocs.large_documents(spark, path, split_bytes).isEmpty():
        return small
    return small.unionByName(jsondocs.split_documents(spark, path, split_bytes))


def read_json_whole(spark: SparkSession, path, max_bytes: int | None = None) -> DataFrame:
    """As `read_json`, a row of text for every file, or every one of up to `max_bytes`: for stores that only Spark opens."""
    files = spark.read.text(path, wholetext=True)
    if max_bytes is not None:
        files = files.filter(F.col("_metadata.file_size") <= max_bytes)
    whole = files.select(F.col("_metadata.file_path").alias("doc"), "value")
    records = records_of_documents(whole, "doc", "value")
    return records.select(F.struct("rec_id.doc", F.col("rec_id.pos").cast("bigint").alias("pos")).alias("rec_id"), "raw")


def records_of_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """Records of JSON documents held in a column, as `(rec_id, raw)`.

    A list gives its elements. An object gives the list under `data`, else its first
    list-valued field in source order, else itself. Anything else gives a null `raw`,
    which `assert_records` reports.
    """
    raw = F.col("raw")
    parsed = df.select(F.col(key).alias("doc"), F.col(text).alias("raw"))
    # A map keeps source order and fields given twice, of which the last value counts, at the place of the first.
    parsed = parsed.select("doc", "raw", J.root_kind(raw).alias("kind"), F.map_entries(J.kinds(raw)).alias("fields"))
    parsed = parsed.withColumn("names", F.transform("fields", lambda e: e["key"]))

    def last(e: Column, i: Column) -> Column:
        return ~F.array_contains(F.slice("names", i + 2, F.size("names")), e["key"])

    is_list = lambda e, i: F.schema_of_variant(e["value"]).startswith("ARRAY") & last(e, i)
    parsed = parsed.withColumn("lists", F.transform(F.filter("fields", is_list), lambda e: e["key"]))
    placed = F.array_sort(F.transform("lists", lambda k: F.struct(F.array_position("names", k).alias("at"), k.alias("name"))))
    chosen = F.when(F.array_contains("lists", "data"), F.lit("data")).otherwise(F.get(placed, F.lit(0))["name"])
    parsed = parsed.select("doc", "raw", "kind", chosen.alias("chosen"))
    entries = F.map_entries(F.from_json(raw, "map<string,string>"))
    value = F.try_element_at(F.filter(entries, lambda e: e["key"] == F.col("chosen")), F.lit(-1))["value"]
    records = (
        F.when(F.col("kind").startswith("ARRAY"), J.root_list(raw))
        .when(F.col("chosen").isNotNull(), J.root_list(value))
        .when(F.col("kind").startswith("OBJECT"), F.array(raw))
        .otherwise(F.array(F.lit(None).cast("string")))
    )
    exploded = each(parsed, ["doc"], records, "pos", "raw")
    return exploded.select(F.struct("doc", "pos").alias("rec_id"), "raw")


def split_corrupt(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records that are JSON objects, the others)."""
    is_object = J.is_object(F.col("raw"))
    return records.filter(is_object), records.filter(~is_object).withColumnRenamed("raw", "_corrupt")


def strict_objects(records: DataFrame) -> DataFrame:
    """Fail the job on the first record that is not a JSON object."""
    message = F.concat(F.lit("not a JSON object: record "), F.to_json(F.struct("rec_id")))
    return records.withColumn("raw", F.when(J.is_object(F.col("raw")), F.col("raw")).otherwise(F.raise_error(message)))


def first_line(spark: SparkSession, path) -> str:
    """The first non-blank line of the first file under `path`, without reading the others.

    What `first_record(read_jsonl(spark, path))` returns, for corpora too large to look
    through for their least record.
    """
    for file in sorted(spark.read.text(path).inputFiles()):
        top = spark.read.text(unquote(file)).select(strip(F.col("value")).alias("raw")).filter("raw <> ''").take(1)
        if top:
            return top[0]["raw"]
    raise CorpusError("dataset is empty")


def first_of_documents(spark: SparkSession, path) -> str:
    """The first record of the first JSON document under `path` that has one, without reading the others."""
    for file in sorted(spark.read.text(path).inputFiles()):
        top = read_json(spark, unquote(file)).orderBy("rec_id").limit(1).select("raw").collect()
        if top and top[0]["raw"] is None:
            raise CorpusError("unsupported JSON document: neither list nor object")
        if top:
            return top[0]["raw"]
    raise CorpusError("dataset is empty")


def first_record(records: DataFrame) -> str:
    """Raw text of the first record, a top-1 by `rec_id`; raises on an empty corpus."""
    top = records.orderBy("rec_id").limit(1).select("raw").collect()
    if not top:
        raise CorpusError("dataset is empty")
    return top[0]["raw"]


def assert_records(records: DataFrame) -> str:
    """The first record, checked to be JSON at all. Reads one top row, not the corpus."""
    raw = first_record(records)
    if raw is None:
        raise CorpusError("unsupported JSON document: neither list nor object")
    return raw
