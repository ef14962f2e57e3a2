"""Mixing sources to target weights: a tempered exponent, budgets, and permutations of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import written

#: Exponents that one pass over the sources tries: five bisections at once.
_SECTIONS = 32
_ROUNDS = 9


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens (runs of other than white space; at least 1) and a hash of id and text of each row."""
    tokens = F.greatest(F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)), F.lit(1)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), tokens.alias("n_tokens"), F.xxhash64("doc_id", "text").alias("same"))


def _bisect(sources: DataFrame, value, holds, rising: bool) -> float:
    """The exponent in [0, 1] at which holds(value) begins (rising) or ends, value being an aggregate of the sources.

    Each pass evaluates evenly spaced exponents in one aggregation, so no list of sources leaves the executors.
    """
    low, high = 0.0, 1.0
    for _ in range(_ROUNDS):
        tried = [low + (high - low) * i / _SECTIONS for i in range(_SECTIONS + 1)]
        found = sources.agg(*[value(a).alias(f"v{i}") for i, a in enumerate(tried)]).first()
        good = [holds(x) for x in found]
        if rising:
            first = good.index(True) if True in good else _SECTIONS
            low, high = tried[max(first - 1, 0)], tried[first]
        else:
            last = max((i for i, x in enumerate(good) if x), default=0)
            low, high = tried[last], tried[min(last + 1, _SECTIONS)]
        if low == high:
            break
    return high if rising else low


def exponent(sources: DataFrame, entropy: float, repetition: float, budget_share: float) -> float:
    """The largest exponent in [0, 1] whose weights share ** exponent have `entropy` times the most entropy possible.

    If that repeats a source over `repetition` times at this budget (as a share of all tokens), the smallest
    exponent that doesn't; 1, the sources' own shares, where none does.
    """
    most = F.log(F.count("*"))

    def spread(a: float):
        power = F.exp(F.lit(a) * F.log("share"))
        z = F.sum(power)
        return (F.log(z) - F.lit(a) * F.sum(power * F.log("share")) / z) - F.lit(entropy) * most

    def repeated(a: float):
        return F.max(F.exp(F.lit(a - 1) * F.log("share"))) / F.sum(F.exp(F.lit(a) * F.log("share"))) * budget_share

    flat = _bisect(sources, spread, lambda x: x is not None and x >= -1e-12, rising=False)
    whole = _bisect(sources, repeated, lambda x: x is not None and x <= repetition * (1 + 1e-12), rising=True)
    return max(flat, whole)


def weights(tokens: DataFrame, entropy: float, repetition: float, budget: int | None) -> DataFrame:
    """source, total tokens, share, weight and budget of each source."""
    sources = tokens.groupBy("source").agg(F.sum("n_tokens").alias("total"))
    everything = sources.agg(F.sum("total")).first()[0] or 0
    if not everything:
        return sources.select("source", "total", F.lit(0.0).alias("share"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("budget"))
    budget = everything if budget is None else budget
    sources = written(sources.withColumn("share", F.col("total") / F.lit(float(everything))))
    a = exponent(sources, entropy, repetition, budget / everything)
    power = F.exp(F.lit(a) * F.log("share"))
    z = sources.agg(F.sum(power)).first()[0]
    return sources.withColumn("weight", power / F.lit(z)).withColumn("budget", F.col("weight") * F.lit(float(budget)))


def mix(docs: DataFrame, entropy: float = 0.95, repetition: float = 4.0, budget: int | None = None, blocks: int = 1024, seed: int = 17) -> DataFrame:
    """doc_id, source, n_tokens, copy, block_rank and place: the documents that a mixture's epochs take, in order.

    Sources' token shares are raised to an exponent (see `exponent`) and normalised to weights of a budget
    of tokens (by default as many as there are). Each source is dealt by a hash of id and text into `blocks` blocks; a budget of
    several times its tokens takes whole copies, each a permutation of the blocks of its own, and the rest
    is the longest prefix of one more permutation that fits, so a source ends within a block of its budget.
    A source is read in order of copy, block_rank, place. A null source is a source of its own; an empty or
    null text counts one token; repeated rows count and come back each. An empty table gives an empty one.
    """
    tokens = written(token_counts(docs).withColumn("block", F.pmod(F.xxhash64("same", F.lit(seed)), F.lit(blocks)).cast("int")))
    budgets = weights(tokens, entropy, repetition, budget)
    sized = tokens.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    per = budgets.select(F.col("source").alias("of"), "total", "budget").withColumn("whole", F.floor(F.col("budget") / F.col("total")).cast("int"))
    copies = sized.join(per, F.col("source").eqNullSafe(F.col("of"))).withColumn("copy", F.explode(F.sequence(F.lit(0), "whole")))
    # a source has no more rows here than blocks times copies, however large it is
    order = Window.partitionBy("source", "copy").orderBy(F.xxhash64("block", "copy", F.lit(seed)), "block")
    taken = copies.withColumn("block_rank", F.row_number().over(order)).withColumn("until", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    taken = taken.where((F.col("copy") < F.col("whole")) | (F.col("until") <= F.col("budget") - F.col("whole") * F.col("total") + 1e-6))
    taken = taken.select(F.col("source").alias("of"), F.col("block").alias("in"), "copy", "block_rank")
    rows = tokens.join(taken, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in")))
    return rows.select("doc_id", "source", "n_tokens", "copy", "block_rank", F.xxhash64("same", "copy", F.lit(seed + 1)).alias("place"))
