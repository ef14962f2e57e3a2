"""What a compression of rasters can be set to, and the memory that planning sets aside for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codecs with levels: the lowest, the highest, the usual. Fixed values.
LEVELS = {"deflate": (1, 9, 6), "zstd": (1, 22, 9), "lzma": (0, 9, 6)}
#: Codecs that take predictors, and those that take none.
PREDICTED, PLAIN = ("lzw", "deflate", "zstd"), ("none", "packbits", "lzma")
#: The dictionary of each preset of lzma in quarters of a MiB. Fixed values.
LZMA_QUARTERS = (1, 4, 8, 16, 16, 32, 32, 64, 128, 256)
MIB = 1 << 20


def level(codec: Column, asked: Column) -> Column:
    """The level that is used: the asked one or the codec's usual; null where a codec has none."""
    out = F.lit(None).cast("int")
    for name, (_, _, usual) in LEVELS.items():
        out = F.when(codec == name, F.coalesce(asked, F.lit(usual)).cast("int")).otherwise(out)
    return out


def fault(codec: Column, asked: Column, predictor: Column, floating: Column) -> Column:
    """Why settings can't be used, or null. floating: whether samples are."""
    known = F.when(~codec.isin(*PREDICTED, *PLAIN), F.lit("unknown codec"))
    for name, (low, high, _) in LEVELS.items():
        known = known.when((codec == name) & ~F.coalesce(asked.between(low, high), F.lit(True)), f"{name} levels are {low} to {high}")
    known = known.when(~codec.isin(*LEVELS) & asked.isNotNull(), "this codec has no levels")
    known = known.when(~predictor.isin(1, 2, 3), "predictors are 1 to 3").when((predictor != 1) & ~codec.isin(*PREDICTED), "this codec takes no predictor")
    return known.when((predictor == 3) & ~floating, "predictor 3 is for floating-point samples")


def memory_bytes(codec: Column, used: Column) -> Column:
    """What a task of a codec at a level may take, rounded up: more than deflate for lzma's dictionaries and the higher levels of zstd."""
    quarters = F.element_at(F.array(*[F.lit(q) for q in LZMA_QUARTERS]), used + 1)
    zstd = F.when(used <= 9, 32).when(used <= 15, 64).when(used <= 19, 256).otherwise(1024)
    return F.when(codec == "lzma", (F.lit(32 * MIB) + quarters * (3 * MIB)).cast("long")).when(codec == "zstd", zstd.cast("long") * MIB).otherwise(F.lit(4 * MIB).cast("long"))
