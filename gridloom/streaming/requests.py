"""Request logs as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(requests: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """requests, errors and mean seconds of each operation and window of `at`; rows later than the watermark allows are left out.

    Works on streams and on tables alike; state is a row per open window and operation.
    """
    rows = requests.withWatermark("at", late) if requests.isStreaming else requests
    made = rows.groupBy(F.window("at", width).alias("w"), "operation").agg(F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("errors"), F.avg("seconds").alias("mean_seconds"))
    return made.select(F.col("w.start").alias("start"), "operation", "requests", "errors", "mean_seconds")


def sessions(requests: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Each user's runs of requests with no pause of `gap`."""
    rows = requests.withWatermark("at", late) if requests.isStreaming else requests
    made = rows.groupBy(F.session_window("at", gap).alias("w"), "user").agg(F.count("*").alias("requests"))
    return made.select("user", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "requests")


def once(evidence: DataFrame, late: str = "1 day") -> DataFrame:
    """Log rows without repeats of (file, digest, ordinal), as closed files are taken in again after a failure."""
    keys = ["file", "digest", "ordinal"]
    return evidence.withWatermark("at", late).dropDuplicatesWithinWatermark(keys) if evidence.isStreaming else evidence.dropDuplicates(keys)


def cache_hits(requests: DataFrame, size: int = 4) -> DataFrame:
    """(z, x, y, hits, misses) by metatile: the first request of any of its tiles misses and fills them all.

    requests: z, x, y of tiles, at. The state of a metatile is two counts, so a tile that everyone asks for
    costs no more than another.
    """

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits, misses = state.get if state.exists else (0, 0)
        n = sum(len(b) for b in batches)
        if n and not misses:
            misses, n = 1, n - 1
        hits += n
        state.update((hits, misses))
        yield pd.DataFrame([(*key, hits, misses)], columns=["z", "x", "y", "hits", "misses"])

    meta = requests.select("z", F.floor(F.col("x") / size).alias("x"), F.floor(F.col("y") / size).alias("y"))
    if not requests.isStreaming:
        return meta.groupBy("z", "x", "y").agg((F.count("*") - 1).alias("hits"), F.lit(1).cast("long").alias("misses"))
    return meta.groupBy("z", "x", "y").applyInPandasWithState(count, "z int, x long, y long, hits long, misses long", "hits long, misses long", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that there is and gives what it wrote under `path` (append), or its last table (complete)."""
    spark: SparkSession = stream.sparkSession
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/out")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    last = out.agg(F.max("batch")).first()[0]
    return out.where(F.col("batch") == last).drop("batch")
