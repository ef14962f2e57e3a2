"""What the corpus operators share: tables, cut lineage, text as bytes, components of a graph."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.shared import scratch, shared_dir

#: Text bytes that one numpy pass holds; whole documents, so a longer one is a pass of its own.
PASS_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table of the shared folder: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, row: str) -> DataFrame:
    """`df` as a table of the shared folder in buckets of the long `by`, with a unique long `row`; joins on `by` don't shuffle it again."""
    spark = df.sparkSession
    name = f"gridloom_{uuid.uuid4().hex}"
    path = scratch(spark, name)
    n = min(partitions(spark), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    dealt = df.repartition(n, by).withColumn(row, F.monotonically_increasing_id())
    dealt.write.bucketBy(n, by).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever it is made of."""
    return "`" + name.replace("`", "``") + "`"


def fresh(names: list[str], *wanted: str) -> list[str]:
    """The wanted names, lengthened until they clash with none of `names` in any case."""
    taken, out = {x.lower() for x in names}, []
    for x in wanted:
        while x.lower() in taken:
            x += "_"
        taken.add(x.lower())
        out.append(x)
    return out


def arrow_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Bounds the Arrow batches that Python workers get, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and where each text begins and ends; null is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


def passes(ends: np.ndarray, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of `most` bytes together, or of one longer document."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


#: Edges that a task joins by itself before they are joined over all.
LOCAL_EDGES = 100_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as (u, v): each node with the smallest one that it reaches over these."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = local_roots(at[: len(u)], at[len(u) :], len(node))
    moved = root != np.arange(len(node))
    yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node that it reaches.

    Tasks of LOCAL_EDGES edges each turn theirs into stars, which keeps what is connected so; that
    is all if they are one task's. Else large and small stars alternate until the edges no longer change; each round is
    written to the shared folder. A hub's neighbours are reduced to their minimum before the shuffle, and the join
    back to a hub is one that adaptive execution may split.
    """
    shared_dir(edges.sparkSession)
    edge = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    tasks = -(-edge.count() // LOCAL_EDGES)
    edge = edge.repartition(max(1, tasks)).mapInArrow(_stars, "u long, v long").distinct().checkpoint()
    last = None
    while tasks > 1:
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct().checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edge = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
            .checkpoint()
        )
        now = edge.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = edge.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
