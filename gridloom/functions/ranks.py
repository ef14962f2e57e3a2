"""Positions and running sums over a whole table, by ranges of its order instead of one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.shared import scratch


def running(rows: DataFrame, order: list, add: str | None = None, place: str = "place", before: str = "before") -> DataFrame:
    """rows with `place`, its position from 0 in the order, and, for a column `add`, `before`: the sum of it over all rows before.

    Rows are dealt to ranges of the order and written, so that ranges stay what they are; a range is counted from
    the ranges before it, of which there are as many as partitions, and its rows are numbered in a task of their own.
    """
    spark, names, path = rows.sparkSession, rows.columns, scratch(rows.sparkSession)
    taken = {c.lower() for c in [*names, place, before]}
    part, size, first, total, amount = (next(n for k in range(len(taken) + 1) if (n := f"_{c}{k or ''}") not in taken) for c in ("range", "n", "first", "total", "sum"))
    rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    sums = [F.count("*").alias(size)] + ([F.sum(add).alias(amount)] if add else [])
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offset = dealt.groupBy(part).agg(*sums).select(
        part, F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(first), *([F.coalesce(F.sum(amount).over(earlier), F.lit(0)).alias(total)] if add else [])
    )
    own = Window.partitionBy(part).orderBy(*order)
    placed = dealt.join(F.broadcast(offset), part).withColumn(place, F.row_number().over(own) - 1 + F.col(first))
    if add:
        placed = placed.withColumn(before, F.col(total) + F.coalesce(F.sum(add).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.select(*["`" + c.replace("`", "``") + "`" for c in names], place, *([before] if add else []))


def uniform(*parts):
    """A number from 0 to below 1 that follows from the parts, the same on every run and machine."""
    text = F.concat_ws("|", *[p.cast("string") if hasattr(p, "cast") else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2.0**32


def seeded_sample(rows: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """n rows that a hash of the seed and the keys picks, the same on every run; keys tell rows apart."""
    return rows.orderBy(uniform(seed, *[F.col(k) for k in keys]), *keys).limit(n)


def seeded_shuffle(rows: DataFrame, keys: list[str], seed: int, place: str = "place") -> DataFrame:
    """rows with `place`, their position in an order that follows from the seed and the keys."""
    mixed = running(rows.withColumn("_u", uniform(seed, *[F.col(k) for k in keys])), ["_u", *keys], place=place)
    return mixed.drop("_u")


def preview(rows: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first n rows of an order, which each task cuts to n before they meet."""
    return rows.orderBy(*order).limit(n)
