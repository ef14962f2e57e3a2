"""Made-up rasters: seeded samples that are the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.ranks import uniform


def noise(spark: SparkSession, width: int, height: int, bands: int = 3, corner: int = 0, seed: int = 1) -> DataFrame:
    """(src, ord, band, x, y, v, valid): bytes that a hash of seed, band and place gives, zero in a corner of so many samples."""
    rows = spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"), F.explode(F.sequence(F.lit(1), F.lit(bands))).alias("band"))
    value = F.floor(uniform(seed, F.col("band"), F.col("x"), F.col("y")) * 256).cast("double")
    zero = (F.col("x") < corner) & (F.col("y") < corner)
    return rows.select(F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("ord"), "band", "x", "y", F.when(zero, 0.0).otherwise(value).alias("v"), F.lit(True).alias("valid"))


def broken_rules(config: DataFrame, rules: dict[str, object]) -> DataFrame:
    """(rule) of the invariants that a configuration, read with spark.read.json, breaks; a rule is a condition on its columns, null breaks it."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
    return config.select(F.explode(names).alias("rule")).distinct()
