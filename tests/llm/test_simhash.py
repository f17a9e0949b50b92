import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chatprep.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, root string"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(nodes, linked):
    root = {}
    for n in nodes:
        if n not in root:
            group, stack = {n}, [n]
            while stack:
                x = stack.pop()
                new = {y for y in nodes if y not in group and linked(x, y)}
                group |= new
                stack += new
            root |= {x: frozenset(group) for x in group}
    return root


def brute(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    root = components({f for _, f in prints}, lambda x, y: (x ^ y).bit_count() <= 4)
    first = {}
    for i, f in prints:
        if i is not None:
            first[root[f]] = min(i, first.get(root[f], i))
    return sorted(((i, f"{f:016x}", first.get(root[f])) for i, f in prints), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    rows = []
    for g in range(40):
        base = [rng.choice("alpha beta gamma delta Eps ZETA é".split()) + str(rng.randint(0, 50)) for _ in range(rng.choice([3, 30, 300]))]
        for _ in range(rng.choice([1, 2, 9])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                words[rng.randrange(len(words))] = "changed"
            rows.append((len(rows), rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(900, None), (901, ""), (902, " \x0b\n"), (None, rows[0][1]), (None, None), (3, rows[3][1]), (3, rows[3][1]), (950, "one two three"), (None, "alone in the world " * 9)]
    return rows + [(960, "word " * 120_000)]


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    near = S.near_duplicates(df).select("id", S.hex_fingerprint(), "component_id")
    assert sorted((tuple(r) for r in near.collect()), key=repr) == brute(rows)
    assert S.near_duplicates(df.limit(0)).collect() == []


def test_one_of_each_component_stays(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    found = kept.collect()
    want = brute(rows)
    assert len(found) == len({c for _, _, c in want if c is not None}) + len({f for _, f, c in want if c is None})
    assert {r["doc_id"] for r in found} == {c for _, _, c in want}
    assert S.keep_one(df.limit(0)).collect() == []


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_links_of_fingerprints(spark, blocks):
    """Chains, and one large group of near fingerprints, cut into parts of a few rows."""
    rng = np.random.default_rng(blocks)
    prints = {int(x) for x in rng.integers(0, 1 << 64, 200, dtype=np.uint64)}
    for start in list(prints)[:30]:
        at = start
        for _ in range(6):
            for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                at ^= 1 << int(b)
            prints.add(at)
    centre = next(iter(prints))
    prints |= {centre ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(150)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long").repartition(4)
    edges = S.close_pairs(df, blocks=blocks, bucket_rows=20).collect()
    graph = {}
    for a, b in edges:
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 64
        graph.setdefault(a, set()).add(b)
        graph.setdefault(b, set()).add(a)
    got = components(prints, lambda x, y: y in graph.get(x, ()))
    want = components(prints, lambda x, y: (x ^ y).bit_count() <= 4)
    assert got == want


def test_one_more_block_for_more_rows():
    assert [S.blocks_for(n) for n in (0, 10**6, 10**8, 10**10, 10**13)] == [5, 5, 6, 7, 8]
    assert all(bin(m % (1 << 64)).count("1") >= 12 for m in S.key_masks(5))


def test_components_of_long_chains(spark):
    from chatprep.llm.graph import components as joined

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in joined(df).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in [100, *range(200, 250)]}
    assert joined(df.filter(F.lit(False))).collect() == []
