"""Resampling to coarser grids, longitude-expanded posts, pyramids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.rects import nearest_index, post_column

CELL = ["band", "x", "y"]
#: Machine epsilon of the double in which sums are kept.
EPSILON = 2.220446049250313e-16


def _shares(axis: str, ratio: float):
    """The target indices that a source cell reaches along an axis, with the overlap: two at most."""
    first = F.floor(F.col(axis) / ratio)

    def share(i):
        return F.greatest(F.lit(0.0), F.least(F.col(axis) + 1.0, (i + 1) * ratio) - F.greatest(F.col(axis) * 1.0, i * ratio))

    made = F.array(*[F.struct((first + k).alias("i"), share(first + k).alias("w")) for k in (0, 1)])
    return F.filter(made, lambda s: s["w"] > 0)


def average(cells: DataFrame, rx: float, ry: float, integer: bool = False, low: float | None = None, high: float | None = None, with_error: bool = False) -> DataFrame:
    """(band, x, y, v) on a grid rx by ry times coarser: area-weighted means of valid samples; cells without any are absent.

    Samples are one per cell (compose sources first), valid where v is not null. integer rounds halves away
    from zero and clips to low..high. with_error adds a bound on the rounding of the sums, from the mean
    absolute input, for verification by another order of summation.
    """
    rows = cells.where("v is not null").select("band", "v", F.explode(_shares("x", rx)).alias("sx"), "y")
    rows = rows.select("band", "v", "sx", F.explode(_shares("y", ry)).alias("sy"))
    rows = rows.select("band", F.col("sx.i").alias("x"), F.col("sy.i").alias("y"), "v", (F.col("sx.w") * F.col("sy.w")).alias("w"))
    mean = F.sum(F.col("v") * F.col("w")) / F.sum("w")
    absolute = F.sum(F.abs("v") * F.col("w")) / F.sum("w")
    made = rows.groupBy(*CELL).agg(mean.alias("v"), absolute.alias("absolute"))
    if integer:
        value = F.round("v")
        value = value if low is None else F.greatest(F.lit(float(low)), value)
        made = made.withColumn("v", value if high is None else F.least(F.lit(float(high)), value))
    if not with_error:
        return made.select(*CELL, "v")
    terms = (int(-(-rx // 1)) + 1) * (int(-(-ry // 1)) + 1)
    gamma = terms * EPSILON / (1 - terms * EPSILON)
    return made.select(*CELL, "v", (F.lit(0.0) if integer else F.col("absolute") * (8 * EPSILON + 4 * gamma)).alias("error"))


def nearest(cells: DataFrame, rx: float, ry: float, width: int, height: int) -> DataFrame:
    """(band, x, y, v) on a coarser grid over a source of width by height: the sample under each centre, where valid.

    Each source cell works out which targets' centres it holds, so nothing is looked up or joined.
    """
    tw, th = int(-(-width // rx)), int(-(-height // ry))

    def targets(axis: str, ratio: float, n: int, size: int):
        guess = F.floor(F.col(axis) / ratio - 0.5)
        near = F.transform(F.array(*[guess + k for k in (-1, 0, 1, 2)]), lambda i: i)
        return F.filter(near, lambda i: (i >= 0) & (i < n) & (nearest_index(i, ratio, 0, size) == F.col(axis)))

    rows = cells.where("v is not null").select("band", "v", F.explode(targets("x", rx, tw, width)).alias("x"), "y")
    return rows.select("band", "x", "v", F.explode(targets("y", ry, th, height)).alias("y")).select(*CELL, "v")


def expand_posts(posts: DataFrame) -> DataFrame:
    """(src, ord, band, x, y, v, valid, rank) of columns `factor` times as many: native posts rank 0, made ones `factor`.

    posts: column x on a grid of factor spacing. Target column l reads source column (2 l + factor) // (2 factor),
    a midpoint the eastern one; so a source column c serves l from c * factor - factor // 2 to
    c * factor + (factor - 1) // 2.
    """
    f, c = F.col("factor"), F.col("x")
    low, high = c * f - F.floor(f / 2), c * f + F.floor((f - 1) / 2)
    reach = F.filter(F.sequence(F.greatest(low, F.lit(0)), F.greatest(high, F.lit(0))), lambda i: post_column(i, f) == c)
    rows = posts.withColumn("target", F.explode(reach))
    return rows.select("src", "ord", "band", F.col("target").alias("x"), "y", "v", "valid", F.when(F.col("target") % f == 0, F.lit(0)).otherwise(f).cast("int").alias("rank"))


def halve(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The next pyramid level: means of 2 by 2 cells (fewer at odd edges) that are there."""
    return cells.groupBy(*keys, F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(F.avg("v").alias("v"))


def pyramid(cells: DataFrame, levels: int, keys: list[str] | None = None) -> DataFrame:
    """level, keys, x, y, v of all levels from 1: each is the mean of its block of the base, in one aggregation.

    Cells are exploded to their block on each level and reduced before the shuffle; for bases of whole blocks
    that is what halving level by level gives.
    """
    keys = ["band"] if keys is None else keys
    rows = cells.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    step = F.pow(F.lit(2.0), F.col("level"))
    return rows.groupBy("level", *keys, F.floor(F.col("x") / step).alias("x"), F.floor(F.col("y") / step).alias("y")).agg(F.avg("v").alias("v"))
