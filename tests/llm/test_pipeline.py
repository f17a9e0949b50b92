import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from chatprep.llm import quality
from tests.llm import test_line_dedup as lines
from tests.llm import test_mixing as mixing
from tests.llm import test_near_copies as near_copies

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(10_000, None, "en", None, None), (None, "a text without id or number", None, "src1", None), (10_001, "", "en", "src2", 0)]
    # Frames on many sources, over texts of their own.
    frame = "subscribe to all of our news by mail"
    odd += [(20_000 + i, f"{frame}\nthe {i} own text of page {i}, which is long enough {i * 7} to stay {i * i}\n{i + 3} more of it", "en", f"src{i % 14}", 9) for i in range(40)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).repartition(3).checkpoint()
    out = [("input", docs)]
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL).checkpoint()
        out.append((name, docs))
    return dict(out)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_stages(kept):
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "mixture", "encode"]
    assert all(kept[n].columns == kept["input"].columns and kept[n].dtypes == kept["input"].dtypes for n in names[:-1])


def test_quality(spark, kept):
    judged = quality.judged(kept["input"], spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = rows(judged.filter("predicted = 1"), "doc_id", "text")
    assert sorted(rows(kept["quality"], "doc_id", "text"), key=repr) == sorted(want, key=repr)
    assert 0.7 < len(want) / kept["input"].count() < 1


def test_line_dedup(kept):
    want = [r[:3] for r in lines.brute(rows(kept["quality"], "doc_id", "text", "source"), 10)]
    assert sorted(rows(kept["line_dedup"], "doc_id", "text", "source"), key=repr) == sorted(want, key=repr)
    changed = kept["line_dedup"].filter("doc_id >= 20000")
    assert changed.filter("text LIKE '%subscribe%' OR n_chars <> length(text)").count() == 0 and changed.count() > 20


def test_near_dedup(kept):
    want = near_copies.brute(rows(kept["line_dedup"], "doc_id", "text"))
    got = [d for d, in rows(kept["near_dedup"], "doc_id")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_mixture(kept):
    taken = [(d, t // n if n else None) for d, _, n, _, _, t in mixing.brute(rows(kept["near_dedup"], "doc_id", "text", "source"))]
    got = {r["doc_id"]: r["n"] for r in kept["mixture"].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(got.get(d, 0) == n for d, n in taken if n is not None)
    assert set(got) <= {d for d, _ in taken}


def test_encode(spark, kept):
    from chatprep.llm import sentencepiece_sampling as S

    texts = {(r["doc_id"], r["source"]): r["text"] for r in kept["mixture"].collect()}
    decoded = S.decode(kept["encode"], S.load()).collect()
    assert {(r["doc_id"], r["source"]) for r in decoded} == set(texts)
    assert all(r["decoded"] == texts[r["doc_id"], r["source"]] for r in decoded)


def test_run(spark):
    got = pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "source", "sample", "ids", "log_probability", "inclusion"]
    again = pipeline.run(spark, SMALL)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, again.collect())) and got.count() > 100


def test_short_pages_lose_their_frame(spark):
    frame = "subscribe to all of our news by mail and never miss a word of it"
    docs = spark.createDataFrame([(i, f"{frame}\nown {i}", "en", f"src{i}", 9) for i in range(12)], spark.read.parquet(f"{SMALL}/documents.parquet").schema)
    got = rows(pipeline.remove_lines(spark, docs, SMALL), "doc_id", "text", "n_chars")
    assert sorted(got) == [(i, f"own {i}", len(f"own {i}")) for i in range(12)]
