"""Choosing candidates from score tables `(ctx_id, token_id, score)`.

A context may hold any share of the candidates. Facts about a context are combinable
aggregates, or top-k filters that Spark applies in each task before the shuffle. Candidates
meet them by context and slice. A bounded sketch of frequent contexts, merged by
aggregation, says which are large; these are cut into slices by a hash of the candidate, as
many as their count asks for, and their facts repeated once per slice. All others are one slice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatprep.functions.hashing import seeded_hash, uniform
from chatprep.sources.shared import stored

SLICE_ROWS = 1 << 20
# Contexts the sketch may name, and those it keeps in mind: any with 1 / 4,000 of the rows is among them.
_NAMED, _TRACKED = 1 << 12, 1 << 16
_MERGED = 64  # slices that compete with each other in one task
_EXPONENT_STEP = 64.0
_DIGIT = 22  # bits that a round of selection looks at


class Slices:
    """How many slices the large contexts have: a table of at most `_NAMED` rows."""

    def __init__(self, rows: DataFrame, ctx: str, slice_rows: int = SLICE_ROWS, *extra: Column):
        self.ctx = ctx
        sketch = F.expr(f"approx_top_k(_h, {_NAMED}, {_TRACKED})").alias("large")
        seen = rows.select(F.xxhash64(ctx).alias("_h"), *[c.alias(f"_x{i}") for i, c in enumerate(extra)])
        found = seen.agg(sketch, *[f(f"_x{i}") for i in range(len(extra)) for f in (F.min, F.max)]).first()
        self.extra = list(found)[1:]
        counts = {r["item"]: math.ceil(r["count"] / slice_rows) for r in found["large"] or []}
        self.large = {h: n for h, n in counts.items() if n > 1}
        self.most = max(self.large.values(), default=1)

    def _numbered(self, rows: DataFrame) -> DataFrame:
        table = rows.sparkSession.createDataFrame(sorted(self.large.items()), "_large long, _slices int")
        return rows.join(F.broadcast(table), F.xxhash64(self.ctx) == F.col("_large"), "left").drop("_large")

    def cut(self, rows: DataFrame, token: str) -> DataFrame:
        """The candidates with their `_slice`."""
        if not self.large:
            return rows.withColumn("_slice", F.lit(0))
        part = F.pmod(F.xxhash64(token), F.coalesce("_slices", F.lit(1))).cast("int")
        return self._numbered(rows).withColumn("_slice", part).drop("_slices")

    def meet(self, sliced: DataFrame, facts: DataFrame) -> DataFrame:
        """Sliced candidates with the facts of their context."""
        if not self.large:
            return sliced.join(facts, self.ctx)
        each = F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))
        return sliced.join(self._numbered(facts).withColumn("_slice", each).drop("_slices"), [self.ctx, "_slice"])


def topk_filter(scores: DataFrame, k: int | None, ctx: str = "ctx_id", token: str = "token_id", score: str = "score", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Candidates scoring at least the k-th highest of their context, all ties kept; no `k`, no filter.

    Candidates compete within their slice first, so ties of any number are not gathered in
    one task; the k-th score is then looked for among the survivors of ever more slices.
    """
    if not k:
        return scores
    slices = Slices(scores, ctx, slice_rows)
    in_slice = W.partitionBy(ctx, "_slice").orderBy(F.desc(score))
    near = slices.cut(scores, token).withColumn("_r", F.rank().over(in_slice)).filter(F.col("_r") <= k)
    # At most k rows of a slice, ties or not, can decide which score is the k-th.
    few, left = near.select(ctx, "_slice", score), slices.most
    while True:
        few = few.withColumn("_i", F.row_number().over(in_slice)).filter(F.col("_i") <= k)
        if left == 1:
            break
        few = few.select(ctx, F.expr(f"_slice div {_MERGED}").alias("_slice"), score)
        left = math.ceil(left / _MERGED)
    kth = few.groupBy(ctx).agg(F.min(score).alias("_kth"))
    return slices.meet(near, kth).filter(F.col(score) >= F.col("_kth")).select(*scores.columns)


def softmax(
    scores: DataFrame, temperature: float = 1.0, ctx: str = "ctx_id", token: str = "token_id", score: str = "score", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Adds `prob`, the softmax of `score / temperature` within a context.

    The denominator is summed per context and per range of 64 exponents, relative to the
    start of the range, so one combinable aggregate neither overflows nor needs the maximum.
    """
    scaled = scores.withColumn("_s", F.col(score) / F.lit(float(temperature)))
    step = F.floor(F.col("_s") / _EXPONENT_STEP)
    sums = scaled.groupBy(ctx, step.alias("step")).agg(F.sum(F.exp(F.col("_s") - step * _EXPONENT_STEP)).alias("z"))
    # One row per range: few per context.
    top = sums.withColumn("top", F.max("step").over(W.partitionBy(ctx)))
    shrunk = F.col("z") * F.exp((F.col("step") - F.col("top")) * _EXPONENT_STEP)
    total = top.groupBy(ctx).agg((F.first("top") * _EXPONENT_STEP + F.ln(F.sum(shrunk))).alias("_log_z"))
    slices = Slices(scores, ctx, slice_rows)
    joined = slices.meet(slices.cut(scaled, token), total)
    return joined.select(*scores.columns, F.exp(F.col("_s") - F.col("_log_z")).alias("prob"))


def _gumbel(seed, ctx: str, token: str):
    return -F.ln(-F.ln(uniform(seeded_hash(seed, F.col(ctx), F.col(token)))))


def sample_scores(
    scores: DataFrame, seed, temperature: float = 1.0, ctx: str = "ctx_id", token: str = "token_id", score: str = "score"
) -> DataFrame:
    """`sample_one` of the softmax of `scores`, without computing it: the denominator shifts all alike."""
    noisy = F.col(score) / F.lit(float(temperature)) + _gumbel(seed, ctx, token)
    return scores.groupBy(ctx).agg(F.max_by(token, noisy).alias(token))


def sample_one(probs: DataFrame, seed, ctx: str = "ctx_id", token: str = "token_id") -> DataFrame:
    """`(ctx_id, token_id)`: one draw per context in proportion to `prob`, the same for the same seed.

    Adds Gumbel noise made from a hash to each log probability and takes the largest.
    """
    noisy = F.ln("prob") + _gumbel(seed, ctx, token)
    return probs.filter("prob > 0").groupBy(ctx).agg(F.max_by(token, noisy).alias(token))


def _descending_bits(prob: Column) -> Column:
    """A long that falls as a positive double rises, and is the same only for the same: the double's bits, turned round."""
    power = F.greatest(F.floor(F.log2(prob)), F.lit(-1000))
    # Near a power of two the logarithm may be rounded across it.
    power = F.when(prob * F.pow(F.lit(2.0), -power) < 1.0, power - 1).when(prob * F.pow(F.lit(2.0), -power) >= 2.0, power + 1).otherwise(power)
    mantissa = (prob * F.pow(F.lit(2.0), -power) - 1.0) * F.lit(float(1 << 52))
    return F.lit((1 << 62) - 1) - ((power + 1023).cast("long") * F.lit(1 << 52) + mantissa.cast("long"))


def nucleus_filter(probs: DataFrame, p: float = 0.9, ctx: str = "ctx_id", token: str = "token_id", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The most probable candidates of each context until their mass reaches `p`; ties by `token`, a whole number.

    Nothing is sorted. A round sums the masses of a context by the leading bits of the
    probability, which says in which bits the limit falls; the next round looks at the next
    bits of the candidates with those, and after the last at the bits of the token, until one
    candidate is left. Then all with smaller or the same bits stay. `probs` is read once a
    round: give a stored table where it is dear to compute.
    """
    rows = probs.filter("prob > 0")
    slices = Slices(rows, ctx, slice_rows, F.col(token))
    least, most = slices.extra
    offset = F.col(token).cast("long") - F.lit(least or 0)
    keyed = [(_descending_bits(F.col("prob")), 62), (offset, max(1, int((most or 0) - (least or 0)).bit_length()))]
    digits = [F.shiftright(key, low).bitwiseAND(F.lit((1 << min(_DIGIT, bits - low)) - 1)) for key, bits in keyed for low in range((bits - 1) // _DIGIT * _DIGIT, -1, -_DIGIT)]
    sliced = slices.cut(rows.select("*", *[d.alias(f"_d{i}") for i, d in enumerate(digits)]), token)
    limits, cuts = None, []
    for i in range(len(digits)):
        within = sliced.withColumn("_above", F.lit(0.0))
        if limits is not None:
            same = [F.col(f"_d{j}") == F.col(f"_cut{j}") for j in range(i)]
            within = slices.meet(sliced, limits)
            for test in same:
                within = within.filter(test)
        mass = within.groupBy(ctx, *cuts, "_above", f"_d{i}").agg(F.sum("prob").alias("_mass"), F.count("*").alias("_n"))
        before = F.sum("_mass").over(W.partitionBy(ctx).orderBy(f"_d{i}").rowsBetween(W.unboundedPreceding, -1))
        reached = mass.withColumn("_before", F.col("_above") + F.coalesce(before, F.lit(0.0))).filter(F.col("_before") < p)
        last = F.max(F.struct(F.col(f"_d{i}").alias("d"), "_before", "_n")).alias("last")
        found = reached.groupBy(ctx, *cuts).agg(last)
        cuts = [*cuts, f"_cut{i}"]
        limits = stored(found.select(ctx, *cuts[:-1], F.col("last.d").alias(f"_cut{i}"), F.col("last._before").alias("_above"), F.col("last._n").alias("_n")), "limits")
        if (limits.agg(F.max("_n")).first()[0] or 0) <= 1:
            break
    mine, theirs = F.struct(*[F.col(f"_d{j}") for j in range(len(cuts))]), F.struct(*[F.col(c).alias(f"_d{j}") for j, c in enumerate(cuts)])
    return slices.meet(sliced, limits).filter(mine <= theirs).select(*probs.columns)
