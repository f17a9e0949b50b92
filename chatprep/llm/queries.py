"""One query per operator of this package, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.llm import collocations, embedding_dedup, line_dedup, merkle, mixing, quality, sentencepiece_sampling, simhash, suffix_tree, topk, toxicity, warc, wordpiece
from chatprep.llm.frames import remainder_of_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document."""
    counted = wordpiece.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), wordpiece.load())
    return counted.drop("text")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every other vector for each whose id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix of all sources takes each document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.with_severity(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", "severity", "grade", "toxic_probability", (F.col("toxic_probability") >= 0.5).cast("int").alias("toxic"))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, by a model of those that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder_of_id("doc_id", 7) == 2
    scored = suffix_tree.scores(documents.withColumn("held_out", held_out), documents.filter(~held_out))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def sampled(documents: DataFrame) -> DataFrame:
    """One row per document and sample: pieces, probabilities, and whether decoding gives the text back."""
    encoded = sentencepiece_sampling.encode(documents.select("doc_id", "text"), sentencepiece_sampling.load())
    each = encoded.select("doc_id", F.posexplode_outer("samples").alias("sample", "one")).select("doc_id", "sample", "one.*")
    return each.select("doc_id", "sample", F.size("ids").alias("n_pieces"), "log_probability", "inclusion", F.xxhash64("ids").alias("ids_hash"), "restored")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct segmentations of every document."""
    return sampled(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by labels of those that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(documents, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that many sources share, and what is left of every document without them."""
    cleaned = line_dedup.remove_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    left = F.col("text")
    return cleaned.select("doc_id", "n_lines", "n_shared", "n_removed", F.length(left).alias("n_chars"), F.md5(left.cast("binary")).alias("text_md5"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of gzipped archives, read back by byte ranges."""
    pages = table(spark, sf_dir, "pages")
    folder = warc.write(pages.select("page_id", "url", "html"))
    records = warc.read(spark, folder, payload=False)
    id_type = dict(pages.dtypes)["page_id"]
    refers_to = F.col("refers_to").cast(id_type).alias("refers_to")
    return records.select(F.col("record_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers_to)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of each language whose words keep together best."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verification of every document; one in seven is looked at after a change."""
    documents = table(spark, sf_dir, "documents")
    told = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    seen = F.when(hit, merkle.leaf([tampered if c == "n_chars" else F.col(c) for c in told]))
    leaves = documents.select("doc_id", "lang", merkle.leaf([F.col(c) for c in told]).alias("leaf"), seen.alias("seen"))
    proven = merkle.manifest(leaves, "doc_id", "lang", "leaf", carry=["seen"])
    proof = proven.withColumn("folded_root", merkle.folded(F.coalesce("seen", "leaf"), F.col("path")))
    return proof.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = [op1_token_counts, op2_top_k, op3_mixture, op4_embedding_dedup, op5_toxicity, op6_suffix_tree, op7_sentencepiece, op8_simhash_dedup, op9_quality, op10_line_dedup, op11_warc, op12_collocations, op13_merkle]
