import random
from itertools import combinations

from chatprep.llm import near_copies as N

SCHEMA = "doc_id long, text string, keys string"


def shingles(text, n=5):
    tokens = [t for t in (text or "").encode().lower().split()]
    return {tuple(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))} if tokens else set()


def brute(rows, similarity=0.8):
    """The ids that stay: the smallest of each group, null last."""
    sets = [shingles(text) for _, text in rows]
    group = list(range(len(rows)))
    for x, y in combinations(range(len(rows)), 2):
        a, b = sets[x], sets[y]
        if group[x] != group[y] and (a == b or len(a & b) >= similarity * len(a | b)):
            old, new = group[y], group[x]
            group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    return [None if none else i for none, i in least.values()]


def made(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed):
    """Texts with versions at every distance around the limit, some in chains, and odd ones."""
    rng = random.Random(seed)
    rows = []
    for length in [3, 5, 6, 9, 30, 80, 200, 900] * 3:
        text = made(rng, length)
        for changes in [0, 0, *range(1, 9)]:
            version = list(text)
            for _ in range(max(1, length // 150) * changes if changes else 0):
                version[rng.randrange(length)] = rng.choice(["new", "other", "more"])
            rows.append(" ".join(version) if rng.random() < 0.5 else "\n ".join(version).upper())
            text = version if rng.random() < 0.5 else text
    rng.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)]
    return rows + [(900, None), (901, ""), (902, " \n"), (None, rows[3][1]), (None, "a text by itself without an id"), rows[5]]


def kept(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5)
    got = N.keep_one(df, **settings)
    assert got.columns == ["doc_id", "text", "keys"]
    return sorted((r["doc_id"] for r in got.collect()), key=repr)


def test_against_brute_force(spark):
    rows = corpus(1)
    assert kept(spark, rows) == sorted(brute(rows), key=repr)


def test_groups_in_parts(spark, monkeypatch):
    """Groups heavier than a part meet in several tasks, with the same result."""
    monkeypatch.setattr(N, "KEY_ROWS", 4)
    monkeypatch.setattr(N, "PART_SHINGLES", 300)
    rows = corpus(2)
    assert kept(spark, rows) == sorted(brute(rows), key=repr)


def test_long_texts_and_large_groups(spark):
    rng = random.Random(3)
    long = made(rng, 200_000, 5000)
    rows = [(0, " ".join(long)), (1, " ".join(long[:190_000])), (2, " ".join(long[:100_000]))]
    page = made(rng, 120)
    rows += [(10 + i, " ".join([*page, str(i)])) for i in range(1500)]
    assert kept(spark, rows) == [0, 10, 2]


def test_no_rows(spark):
    assert N.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shuffles_of_finished_steps_go(spark, monkeypatch):
    def count():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))

    found, kept_as = [], N.stored

    def stored(df, label):
        out = kept_as(df, label)
        found.append((label, count()))
        return out

    monkeypatch.setattr(N, "stored", stored)
    before = count()
    kept(spark, corpus(4))
    assert [n for label, n in found if label == "near"][0] <= before
