import hashlib
import random
import re

import pytest

from chatprep.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string"


def brute(rows, cycle=(5, 2, 1), most=3):
    """By sorting: reshare until no source is above its limit, then take rows by hash up to the nearest sum."""
    sizes = {}
    digest = []
    for doc_id, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        key = str(doc_id) if doc_id is not None else hashlib.md5(text.encode()).hexdigest() if text is not None else ""
        h = int(hashlib.md5(f"{M.SEED}:{key}".encode()).hexdigest()[:15], 16)
        sizes[source] = sizes.get(source, 0) + n
        digest.append((doc_id, source, n, h))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left, w = total - sum(most * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and most * sizes[s] * w <= weight[s] * left}
        if not above:
            break
        full |= above
    target = {s: float(most * sizes[s]) if s in full else weight[s] * left / w for s in order}
    out = []
    for s in order:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        budget, upto, below = target[s] - whole * sizes[s], (1 << 60) - 1, 0
        for h in sorted({x[3] for x in digest if x[1] == s}):
            n = sum(x[2] for x in digest if x[1] == s and x[3] == h)
            if below + n > budget:
                upto = h if below + n - budget < budget - below else h - 1
                break
            below += n
        out += [(d, s, n, sizes[s], target[s], n * min(most, whole + (h <= upto))) for d, x, n, h in digest if x == s]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_sorting(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "b", "z", "é", "𝕏"]
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 40]))), rng.choice(names + ["hot"] * 6)) for i in range(300)]
    rows += [(500 + i, None, "only nulls") for i in range(3)] + [(None, "x y", "a"), (None, None, "a"), (None, "x y", "a"), (7, "dup", "b"), (7, "dup", "b")]
    rows += [(900, "long " * 50_000, "hot")] if seed == 2 else []
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(4)
    got = M.mix(df)
    assert got.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    found = [(r["doc_id"], r["source"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(brute(rows), key=repr)
    again = M.mix(df.repartition(7)).collect()
    assert sorted(again, key=repr) == sorted(got.collect(), key=repr)


def test_nested_budgets(spark):
    digest = spark.createDataFrame([("s", (i * 7919 % 5000) << 40, 1 + i % 3) for i in range(5000)], "source string, h long, size long")
    budgets = spark.createDataFrame([("s", float(b)) for b in (0, 1, 777, 5000, 10**9)], "source string, budget double")
    upto = [r["upto"] for r in M.thresholds(digest, budgets).orderBy("budget").collect()]
    assert upto == sorted(upto) and upto[-1] == (1 << 60) - 1
    for budget, t in zip((0, 1, 777, 5000), upto):
        assert abs(digest.filter(f"h <= {t}").agg({"size": "sum"}).first()[0] or 0 - budget) - budget <= 3


def test_no_rows(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    only = M.mix(spark.createDataFrame([(1, "", None, ""), (2, None, None, "")], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in only] == [(0, 0.0, 0)] * 2
