import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chatprep.llm import merkle as M

SCHEMA = "id long, lang string, text string, `group` string, leaf string, block string, path string, root string, pos string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def proofs(nodes, fanout):
    """The root over the nodes and the siblings of each, level by level."""
    at, path = list(range(len(nodes))), [[] for _ in nodes]
    level = nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            start = p - p % fanout
            path[i].append(("".join(level[start:p]), "".join(level[p + 1 : start + fanout])))
            at[i] = p // fanout
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0] if level else None, path


def brute(rows, fanout):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, sha("".join(told(x) for x in row[:3])), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        found[name] = proofs([x[2] for x in groups[name]], fanout)
    root, upper = proofs([found[n][0] for n in names], fanout)
    out = []
    for name, above in zip(names, upper):
        subroot, paths = found[name]
        out += [(x[3], x[2], subroot, root, tuple(p + above)) for x, p in zip(groups[name], paths)]
    return sorted(out, key=repr)


def corpus(rng, sizes):
    rows = [(i, lang, rng.choice(["", "word", "äöü " * rng.randint(0, 9)])) for lang, n in sizes.items() for i in rng.sample(range(100_000), n)]
    rows += [rows[0], rows[0], (None, "en", None), (None, None, "x"), (rows[0][0], rows[0][1], "another text of the same id"), (-5, "en", "long " * 300_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("fanout, block_rows", [(2, 4), (2, 4096), (3, 9), (5, 1), (4, 20)])
def test_against_brute_force(spark, fanout, block_rows):
    """Groups of one leaf to many blocks, last blocks and subtrees of any size."""
    rng = random.Random(fanout * 100 + block_rows)
    rows = corpus(rng, {"en": 150, "de": 37, "fr": 17, "es": 16, "": 1, "日本": 3, "z": 2, None: 9})
    df = spark.createDataFrame([(*r, "g", "l", "b", "p", "r", "o") for r in rows], SCHEMA).repartition(5)
    df = df.withColumn("own", M.leaf([F.col("id"), F.col("lang"), F.col("text")]))
    got = M.manifest(df, "id", "lang", "own", fanout=fanout, block_rows=block_rows)
    assert got.columns == ["id", "leaf", "subroot", "root", "path"]
    seen = got.withColumn("folded", M.folded(F.col("leaf"), F.col("path"))).withColumn("proof", M.proof_digest(F.col("path"))).collect()
    assert all(r["folded"] == r["root"] for r in seen)
    assert all(r["proof"] == sha("".join(a + b for a, b in r["path"])) for r in seen)
    assert sorted(((r["id"], r["leaf"], r["subroot"], r["root"], tuple(tuple(s) for s in r["path"])) for r in seen), key=repr) == brute(rows, fanout)


def test_a_change_is_found(spark):
    rows = [(i, "en", f"text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, lang string, text string").withColumn("own", M.leaf([F.col("id"), F.col("text")]))
    df = df.withColumn("seen", M.leaf([F.col("id"), F.when(F.col("id") == 7, "changed").otherwise(F.col("text"))]))
    proven = M.manifest(df, "id", "lang", "own", carry=["seen"], block_rows=4)
    wrong = proven.filter(M.folded(F.col("seen"), F.col("path")) != F.col("root")).collect()
    assert [r["id"] for r in wrong] == [7]


def test_no_rows_and_a_single_one(spark):
    empty = spark.createDataFrame([], "id long, lang string, own string")
    assert M.manifest(empty, "id", "lang", "own").collect() == []
    one = M.manifest(spark.createDataFrame([(1, None, "ab")], "id long, lang string, own string"), "id", "lang", "own").first()
    assert (one["leaf"], one["subroot"], one["root"], one["path"]) == ("ab", "ab", "ab", [])
