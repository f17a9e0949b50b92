"""Mixing sources to target weights by thresholds on a hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatprep.llm.frames import WORD, hint_small, put_back, set_apart
from chatprep.operators.ranks import ordered_rank
from chatprep.sources.shared import pinned, stored

SEED = 7
CYCLE = (5, 2, 1)
MAX_REPEATS = 3
_BITS = 60  # 15 hex digits of an md5
_STEP = 12  # bits a histogram resolves
_MAX_ROUNDS = 100_000


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(id_col: str, text_col: str, seed: int = SEED) -> Column:
    """60 bits of md5 of seed and id; rows without an id go by their text."""
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary")), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, cycle=CYCLE, max_repeats: int = MAX_REPEATS, share: float = 1.0) -> DataFrame:
    """Adds `weight` and `target` to rows `(source, source_size)`.

    Sources by code point, null last, take the weights of `cycle` in turn. They share
    `share` of all sizes by weight, none above `max_repeats` times its own; what a source
    cannot take is shared again among the others. `source` null is a source.
    """
    keyed = sizes.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_key", F.coalesce("source", F.lit("")))
    ranked = ordered_rank(keyed, ["_null", "_key"], rank="_rank").drop("_null", "_key")
    weights = F.element_at(F.array(*[F.lit(int(w)) for w in cycle]), (F.col("_rank") % len(cycle) + 1).cast("int"))
    table = pinned(ranked.withColumn("weight", weights.cast("long")).drop("_rank"))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    total = total if share == 1.0 else round(total * share)
    cap = F.col("source_size") * max_repeats
    left, weight = total, None
    for _ in range(_MAX_ROUNDS):  # sources only ever join those at their cap, and at least one does in each round
        above = F.lit(False) if weight is None else cap * F.lit(weight) <= F.col("weight") * F.lit(left)
        full, rest = table.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        now = (total - (full or 0), rest or 0)
        if now == (left, weight) or not rest:
            break
        left, weight = now
    even = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(weight or 1))
    return table.withColumn("target", F.least(cap.cast("double"), even))


def thresholds(digest: DataFrame, budgets: DataFrame) -> DataFrame:
    """Adds `upto` to budgets `(source, budget, ...)`: rows of the source with `h <= upto` hold sizes that come nearest to it.

    `digest` has `(source, h, size)`. A histogram over the leading bits of the hash says in
    which bucket a budget falls; only that bucket's rows are counted again by their next
    bits, until it holds a single hash. Smaller budgets take subsets of larger ones. A tie
    between with and without the last hash goes to without; -1 takes nothing.
    """
    named = budgets.withColumn("_b", F.struct("source", "budget"))
    open_ = named.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    done = []
    for used in range(0, _BITS, _STEP):
        rest = _BITS - used - _STEP
        open_ = hint_small(pinned(open_))
        rows = digest.withColumn("prefix", F.shiftright("h", _BITS - used))
        inside = rows.withColumnRenamed("source", "_s").join(open_.withColumnRenamed("prefix", "_p"), F.col("_s").eqNullSafe(F.col("source")) & (F.col("prefix") == F.col("_p")))
        counts = inside.groupBy("source", "budget", "below", F.shiftright("h", rest).alias("prefix")).agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        running = W.partitionBy("source", "budget").orderBy("prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
        placed = counts.withColumn("upto_here", F.col("below") + F.sum("n").over(running))
        # The first bucket that goes beyond the budget; at most 4096 buckets to a window.
        hit = placed.filter("upto_here > budget").groupBy("source", "budget").agg(F.min_by(F.struct("prefix", "upto_here", "n", "lo", "hi"), "prefix").alias("x"))
        hit = pinned(hit.select("source", "budget", "x.*").withColumn("below", F.col("upto_here") - F.col("n")))
        single = hit.filter("lo = hi")
        nearer = F.col("upto_here") - F.col("budget") < F.col("budget") - F.col("below")
        done.append(single.select("source", "budget", F.when(nearer, F.col("lo")).otherwise(F.col("lo") - 1).alias("upto")))
        open_ = hit.filter("lo < hi").select("source", "budget", "prefix", "below")
        if open_.isEmpty():
            break
    found = reduce(DataFrame.union, done).select(F.struct("source", "budget").alias("_b"), "upto")
    # A budget that no bucket exceeds takes all.
    return named.join(found, "_b", "left").drop("_b").withColumn("upto", F.coalesce("upto", F.lit((1 << _BITS) - 1)))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle=CYCLE, max_repeats: int = MAX_REPEATS, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """The rows with `size`, `source_size`, `target`, `copies` and `taken`: how often the mix takes each, and words so taken.

    A source whose target is r times its size takes every row floor(r) times, and once more
    the rows whose hash is up to a threshold, chosen so that the source comes as near to its
    target as whole rows allow. No row moves and nothing is sorted: one pass for a slim
    digest, histograms, then a filter against one row per source.

    Rows that repeat an id go together. Null or empty texts have size 0 and are taken as
    their hash says. Columns of the input with the names of the results are replaced, all
    others stay as they are, whatever they are called; an empty table gives an empty one. A
    text of any length is counted where it is.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    wanted = [c for c in df.columns if c in (id_col, text_col, source_col) or c not in added]
    rows, names = set_apart(df.select(*wanted), id_col, text_col, source_col)
    slim = rows.select(F.col(source_col).alias("source"), row_hash(id_col, text_col, seed).alias("h"), word_count(F.col(text_col)).alias("size"))
    digest = stored(slim, "mix")
    targets = source_targets(digest.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, max_repeats, share)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = pinned(targets.withColumn("_full", full.cast("long")).withColumn("budget", F.col("target") - F.col("_full") * F.col("source_size")))
    plan = pinned(thresholds(digest, plan.select("source", "budget", "source_size", "target", "_full")))
    facts = ["source", "source_size", "target", "_full", "upto"]
    marks = hint_small(plan.select(*[F.col(c).alias(f"_of_{c}") for c in facts]))
    sized = rows.withColumn("_size", word_count(F.col(text_col))).withColumn("_h", row_hash(id_col, text_col, seed))
    joined = sized.join(marks, F.col(source_col).eqNullSafe(F.col("_of_source")))
    copies = F.least(F.col("_of__full") + (F.col("_h") <= F.col("_of_upto")).cast("long"), F.lit(max_repeats).cast("long"))
    told = joined.withColumn("_copies", copies).withColumn("_taken", copies * F.col("_size"))
    made = ["_size", "_of_source_size", "_of_target", "_copies", "_taken"]
    return put_back(told, names, wanted, [F.col(m).alias(a) for m, a in zip(made, added)])
