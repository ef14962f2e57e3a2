"""Exact statistics, comparisons, quality metrics and the search for unused values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def statistics(cells: DataFrame, keys: list[str]) -> DataFrame:
    """minimum, maximum, mean, population stddev, valid and missing pixels and valid percent per key; null without valid samples."""
    v = F.when(F.col("valid"), F.col("v"))
    n = F.count(v)
    return cells.groupBy(*keys).agg(
        F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"),
        n.alias("valid_pixels"), (F.count("*") - n).alias("nodata_pixels"), (100.0 * n / F.count("*")).alias("valid_percent"),
    )


def statistics_differ(a: DataFrame, b: DataFrame, keys: list[str], relative: float = 1e-12) -> DataFrame:
    """Keys whose statistics aren't the same: extremes and counts exactly, moments within a relative tolerance."""
    exact, near = ["minimum", "maximum", "valid_pixels", "nodata_pixels"], ["mean", "stddev"]
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in exact + near])
    joined = a.join(right, keys, "full_outer")
    same = F.lit(True)
    for c in exact:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    for c in near:
        x, y = F.col(c), F.col(f"b_{c}")
        same = same & (x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= relative * F.greatest(F.lit(1.0), F.abs(x), F.abs(y)), F.lit(False)))
    return joined.where(~same).select(*keys)


def quality(pairs: DataFrame, keys: list[str], peak: float = 255.0) -> DataFrame:
    """mae, rmse, psnr, max_error, differing and samples of reference against candidate values (columns a, b, valid).

    Means are over valid samples, extremes and differences over all. psnr is null where nothing differs (infinite).
    """
    e = F.col("a") - F.col("b")
    good = F.col("valid")
    mse = F.avg(F.when(good, e * e))
    return pairs.groupBy(*keys).agg(
        F.avg(F.when(good, F.abs(e))).alias("mae"), F.sqrt(mse).alias("rmse"), F.when(mse > 0, 10 * F.log10(peak * peak / mse)).alias("psnr"),
        F.max(F.abs(e)).alias("max_error"), F.count_if(e != 0).alias("differing"), F.count("*").alias("samples"),
    )


def valid_fraction(pixels: DataFrame) -> DataFrame:
    """The share of pixels (array column `bands`) with any band other than zero."""
    return pixels.agg((F.count_if(F.exists("bands", lambda x: x != 0)) / F.count("*")).alias("valid_fraction"), F.count("*").alias("pixels"))


def ssim(a: Column, b: Column, peak: float = 255.0) -> Column:
    """Structural similarity of two windows, given as arrays of samples: the whole window is one patch."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    ma, mb = total(a) / n, total(b) / n
    va, vb = total(F.transform(a, lambda x: (x - ma) * (x - ma))) / n, total(F.transform(b, lambda x: (x - mb) * (x - mb))) / n
    cov = total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb))) / n
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    return ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def occupied(cells: DataFrame, candidates: list[float]) -> DataFrame:
    """candidate, ordinal, occupied: which values some valid sample has, in the order given; NaN matches NaN.

    One aggregation over all samples, those that win no overlap included.
    """
    spark = cells.sparkSession
    values = spark.createDataFrame([(i, float(c)) for i, c in enumerate(candidates)], "ordinal int, candidate double")
    v = F.when(F.col("valid"), F.col("v").cast("double"))
    seen = cells.agg(*[F.coalesce(F.bool_or(F.isnan(v) if c != c else v == F.lit(float(c))), F.lit(False)).alias(f"c{i}") for i, c in enumerate(candidates)])
    flags = seen.select(F.array(*[f"c{i}" for i in range(len(candidates))]).alias("flags"))
    return values.join(F.broadcast(flags), F.lit(True)).select("ordinal", "candidate", F.get("flags", F.col("ordinal")).alias("occupied"))


def _smallest_free(used: DataFrame, low: int, high: int) -> DataFrame:
    """unused: the smallest number from low to high that isn't among the distinct longs `v`; no row if all are.

    Gaps are looked for within ranges of the domain, each of which is full only if it holds as many values as it
    is wide, and then only in the first that isn't.
    """
    width = 1 << 16
    slot = F.shiftright(F.col("v") - F.lit(low), 16)
    full = used.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).where(F.col("n") == width).select("slot")
    ordered = full.withColumn("i", F.row_number().over(Window.orderBy("slot")) - 1)
    first = ordered.where(F.col("slot") == F.col("i")).agg(F.count("*").alias("slot"))
    start = first.select((F.lit(low) + F.col("slot") * width).cast("long").alias("start"))
    domain = start.where(F.col("start") <= high).select(F.explode(F.sequence("start", F.least(F.col("start") + width - 1, F.lit(high).cast("long")))).alias("v"))
    return domain.join(used, "v", "left_anti").agg(F.min("v").alias("unused")).where("unused is not null")


def smallest_unused(cells: DataFrame, low: int, high: int) -> DataFrame:
    """The smallest whole number from low to high that no valid sample has; no row if all are taken. Distinct values are reduced before the shuffle."""
    used = cells.where(F.col("valid") & F.col("v").between(low, high) & (F.col("v") == F.floor("v"))).select(F.floor("v").cast("long").alias("v")).distinct()
    return _smallest_free(used, low, high)


#: Of the types of floating-point samples: the column's type, the class that knows its bits, the functions to bits and back, and the bits of infinity.
_FLOATS = {
    "float32": ("float", "int", "java.lang.Float", "floatToRawIntBits", "intBitsToFloat", 0x7F800000),
    "float64": ("double", "long", "java.lang.Double", "doubleToRawLongBits", "longBitsToDouble", 0x7FF0000000000000),
}
#: The least and the largest number of the types of whole samples.
_WHOLE = {f"{sign}int{n}": (-(1 << n - 1) if not sign else 0, (1 << n - (not sign)) - 1) for n in (8, 16, 32) for sign in ("", "u")}


def value_key(v: Column, dtype: str) -> Column:
    """The number of a stored value among those of its type, as a long.

    Whole numbers count from the type's least one. Of floating-point numbers it is the IEEE bits, so a sign makes the key of a double
    negative and that of a float 2^31 or more; both zeros have 0 and no NaN has a key.
    """
    if dtype in _WHOLE:
        return v.cast("long") - F.lit(_WHOLE[dtype][0])
    kind, _, java, bits, _, _ = _FLOATS[dtype]
    v = v.cast(kind)
    raw = F.reflect(F.lit(java), F.lit(bits), F.coalesce(v, F.lit(0.0).cast(kind))).cast("long")
    return F.when(v.isNull() | F.isnan(v), None).when(v == 0, 0).otherwise(raw.bitwiseAND(F.lit(0xFFFFFFFF)) if kind == "float" else raw)


def unused_value(cells: DataFrame, dtype: str) -> DataFrame:
    """value: the first number of the type that no valid sample has, as a double; no row if all are taken.

    Whole numbers are tried from the least up. Of floating-point numbers each is tried that the type can hold, by its bits: from zero up to infinity,
    then, only if all of these are taken, from the negative one next to zero down. NaN samples take nothing.
    """
    if dtype in _WHOLE:
        return smallest_unused(cells, *_WHOLE[dtype]).select(F.col("unused").cast("double").alias("value"))
    kind, whole, java, _, back, most = _FLOATS[dtype]
    v = F.col("v").cast(kind)
    for sign, side in ((1, v >= 0), (-1, v < 0)):
        used = cells.where(F.col("valid") & v.isNotNull() & ~F.isnan(v) & side).select(value_key(F.abs(v), dtype).alias("v")).distinct()
        found = _smallest_free(used, 0 if sign == 1 else 1, most)
        found = found.select((F.reflect(F.lit(java), F.lit(back), F.col("unused").cast(whole)).cast(kind).cast("double") * sign).alias("value"))
        if sign == -1 or not found.isEmpty():
            return found


def suggest_nodata(cells: DataFrame, common: list[float], low: int, high: int) -> DataFrame:
    """The common choices that are free, in order, or else the smallest unused value."""
    free = occupied(cells, common).where("not occupied").select("ordinal", F.col("candidate").alias("value"))
    if free.isEmpty():
        return smallest_unused(cells, low, high).select(F.lit(len(common)).alias("ordinal"), F.col("unused").cast("double").alias("value"))
    return free


def valid_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count_if("valid").alias("valid_samples"), F.count_if(~F.col("valid")).alias("invalid_samples"))
