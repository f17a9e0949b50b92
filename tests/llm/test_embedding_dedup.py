import math

import numpy as np
import pytest

from chatprep.llm import embedding_dedup as D

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, threshold=0.93):
    ok = {i: (np.array(v, np.float32).astype(float), lab) for i, v, lab in rows
          if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    near = {i: set() for i, _, _ in rows}
    for a, (x, la) in ok.items():
        for b, (y, lb) in ok.items():
            if a < b and la == lb and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                near[a].add(b)
                near[b].add(a)
    out = set()
    for i in near:
        seen, stack = {i}, [i]
        while stack:
            for j in near[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        out.add((i, len(near[i]), min(seen), min(seen) == i))
    return out


@pytest.mark.parametrize("block_rows", [13, 2048])
def test_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 64))
    rows = []
    for i in range(260):
        c = centres[rng.integers(12)]
        v = c + rng.standard_normal(64) * rng.choice([0.0, 0.2, 0.27, 0.4, 2.0])
        rows.append((i, [float(x) for x in v * rng.choice([1, 1000, 1e-3])], int(rng.integers(3) and 1)))
    rows += [(300 + i, rows[0][1], rows[0][2]) for i in range(40)]  # a large group of copies
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(6)
    got = D.near_duplicates(df, block_rows=block_rows)
    assert got.columns == ["id", "n_links", "component_id", "kept"]
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, None), (4, None, 1), (5, [0.0] * 3, 1), (6, [1.0, None, 3.0], 1), (7, [math.nan] * 3, 1),
        (8, [math.inf, 1.0, 1.0], 1), (9, [1.0, 2.0], 1), (10, [], 1), (11, v, 2), (12, [1e38, 2e38, 3e38], 1), (13, [0.5], 1), (14, [7.0], 1), (15, [-7.0], 1),
    ]
    df = spark.createDataFrame([(*r, None) for r in [*rows, rows[0], (None, v, 1)]], SCHEMA)
    assert {tuple(r) for r in D.near_duplicates(df).collect()} == brute(rows)
    assert D.near_duplicates(df.limit(0)).collect() == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((400, 64)), rng.standard_normal((300, 64))
    b[:100] = a[:100] + rng.standard_normal((100, 64)) * 0.25
    true = D.unit(a) @ D.unit(b).T
    codes, factors = D.encode(a)
    error = D.estimates(codes, factors, D.rotated(b)) - true
    assert abs(error.mean()) < 2e-3
    spread = np.sqrt(1 - true**2) * (np.sqrt(1 - factors**2) / factors / np.sqrt(63))[:, None]
    assert 0.9 < (error / spread).std() < 1.1
    close = true >= 0.93
    assert close.sum() > 50
    least = np.broadcast_to(D.least_estimate(factors, 64, 0.93, D.SPREADS)[:, None], true.shape)
    assert (error + true >= least)[close].all() and (error + true >= least).mean() < 0.05
