"""Exact quantiles of groups of any size, by refining histograms: no group's values meet in one task."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.shared import written

#: Values of a group that one task may hold; larger groups are refined until what is left of each is no larger.
SMALL = 100_000
#: Cells of a histogram.
CELLS = 1024
#: Intervals up to which they are sent to all tasks.
BROADCAST_INTERVALS = 100_000


def summary(rows: DataFrame, keys: list[str], value: str, named: dict[str, float], aggregates: list[Column] = (), discrete: bool = False) -> DataFrame:
    """keys, aggregates, and under each name its quantile of the values that aren't null: linear between neighbours at (n - 1) q, or
    the first value whose share of rows reaches q. NaN is larger than any number. A group without values has null quantiles.

    One pass counts. Where no group is larger than SMALL, groups are sorted as they are. Else each quantile's rank is looked for in a
    histogram of CELLS cells between the group's extremes, counted before it is shuffled, then in one of the cell that holds
    it, until the cell has one value or SMALL rows; those rows alone are sorted.
    """
    counts = rows.groupBy(*keys).agg(F.count(value).alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    if most <= SMALL:
        pick = (lambda q: F.expr(f"percentile_disc({q!r}) within group (order by `{value}`)")) if discrete else (lambda q: F.percentile(value, q))
        return rows.groupBy(*keys).agg(*aggregates, *[pick(q).alias(name) for name, q in named.items()])
    found = _refined(rows, keys, value, named, discrete)
    made = rows.groupBy(*keys).agg(*(aggregates or [F.count(F.lit(1)).alias("_")]))
    return _met(made, found, keys, "left").select(*made.columns if aggregates else keys, *named)


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str, more: Column | None = None) -> DataFrame:
    """A join on keys that may be null."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + ([more] if more is not None else [])
    return left.join(other, functools.reduce(lambda a, b: a & b, same) if same else F.lit(True), how).drop(*[f"_{k}" for k in keys])


def _ranks(n: Column, q: float, discrete: bool) -> tuple[Column, Column, Column]:
    """The ranks below and above a quantile, from 0, and where it lies between."""
    if discrete:
        at = F.greatest(F.ceil(n * F.lit(q)).cast("long") - 1, F.lit(0).cast("long"))
        return at, at, at.cast("double")
    at = (n - 1) * F.lit(q)
    return F.floor(at).cast("long"), F.ceil(at).cast("long"), at


def _refined(rows: DataFrame, keys: list[str], value: str, named: dict[str, float], discrete: bool) -> DataFrame:
    v = F.col("v")
    values = rows.select(*keys, F.col(value).cast("double").alias("v")).where(v.isNotNull())
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    sized = written(values.groupBy(*keys).agg(F.count("*").alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi")))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(*_ranks(F.col("n"), q, discrete)[:2]) for q in named.values()])))
    goals = sized.select(*keys, F.explode(wanted).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), "n")
    first = True
    while True:
        # a cell that has one value is done; so are small ones, but for their order
        open_ = goals if first else goals.where((F.col("lo") < F.col("hi")) & (F.col("n") > SMALL))
        intervals = open_.select(*keys, "lo", "hi", "below").distinct()
        if not first and not (many := intervals.count()):
            break
        many = BROADCAST_INTERVALS + 1 if first else many
        width = F.col("hi") / 2 - F.col("lo") / 2
        cell = F.least(F.lit(CELLS - 1), F.floor((v / 2 - F.col("lo") / 2) / F.nullif(width, F.lit(0.0)) * CELLS))
        cell = F.when(v == float("-inf"), -1).when(F.isnan(v), CELLS + 1).when(v == float("inf"), CELLS).otherwise(F.coalesce(cell, F.lit(0)))
        side = F.broadcast(intervals) if many <= BROADCAST_INTERVALS else intervals
        inside = _met(values, side, keys, "inner", None if first else v.between(F.col("lo"), F.col("hi")))
        cells = inside.groupBy(*keys, "lo", "hi", "below", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        start = F.col("below") + F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "below").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = cells.select(*keys, F.col("below").alias("within"), "a", "b", F.col("n").alias("m"), start.alias("start"))
        hit = (F.col("below") == F.col("within")) & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("m"))
        found = _met(open_.select(*keys, "rank", "below"), cells, keys, "inner", hit)
        found = found.select(*keys, "rank", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("start").alias("below"), F.col("m").alias("n"))
        done = None if first else goals.where((F.col("lo") >= F.col("hi")) | (F.col("n") <= SMALL))
        goals, first = written(found if done is None else done.unionByName(found)), False
    known = goals.where("lo >= hi").select(*keys, "rank", F.col("lo").alias("v"))
    left = goals.where("lo < hi")
    some = _met(values, left.select(*keys, "lo", "hi", "below").distinct(), keys, "inner", v.between(F.col("lo"), F.col("hi")))
    some = some.groupBy(*keys, "below", "v").agg(F.count("*").alias("m"))
    start = F.col("below") + F.coalesce(F.sum("m").over(Window.partitionBy(*keys, "below").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = some.select(*keys, F.col("below").alias("within"), "v", "m", start.alias("start"))
    hit = (F.col("below") == F.col("within")) & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("m"))
    picked = known.unionByName(_met(left.select(*keys, "rank", "below"), some, keys, "inner", hit).select(*keys, "rank", "v"))
    # of each group a handful of ranks
    maps = picked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    both = _met(sized.select(*keys, "n"), maps, keys, "inner")
    out = []
    for name, q in named.items():
        low, high, at = _ranks(F.col("n"), q, discrete)
        a, b = F.col("at")[low], F.col("at")[high]
        out.append(F.when(low == high, a).when(a == b, a).otherwise((high - at) * a + (at - low) * b).alias(name))
    return both.select(*keys, *out)
