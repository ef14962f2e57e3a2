"""Where files lie: listings, and opening by URI."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.ranks import running


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Paths may be local, file: or of any store that pyarrow opens (s3, gs, abfs, hdfs)."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listing(spark: SparkSession, path: str, suffixes: tuple[str, ...], contains: str | None = None, recursive: bool = False) -> DataFrame:
    """path, name, size, modified and ord (by name, case apart) of files; content isn't read.

    contains: part of the base name in any case, applied before any file is opened.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    rows = found.withColumn("name", name).where(F.lower("name").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    if contains:
        rows = rows.where(F.contains(F.lower("name"), F.lit(contains.lower())))
    return running(rows, [F.lower("path"), "path"], place="ord")


def unlinked(files: DataFrame) -> DataFrame:
    """Rows of a listing whose file is no link and has no other name: symbolic links, and all names of files that have several, go, as what
    changes one would change the other. Only local folders have links."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for path in frame["path"]:
                store, name = opened(path)
                facts = os.lstat(name) if isinstance(store, fs.LocalFileSystem) else None
                keep.append(facts is None or stat.S_ISREG(facts.st_mode) and facts.st_nlink == 1)
            yield frame[keep]

    return files.mapInPandas(run, files.schema)


def by_size(files: DataFrame) -> DataFrame:
    """Largest first, then by name: the order in which long jobs should start."""
    return files.orderBy(F.desc("size"), F.lower("path"))


def folders(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...]) -> DataFrame:
    """Files of several folders, searched with all below; one found twice counts in the first folder. Later folders come later."""
    rows = None
    for i, p in enumerate(paths):
        found = listing(spark, p, suffixes, recursive=True).drop("ord").withColumn("folder", F.lit(i))
        rows = found if rows is None else rows.union(found)
    first = rows.groupBy("path").agg(F.min_by(F.struct("size", "modified", "name", "folder"), "folder").alias("f")).select("path", "f.*")
    return running(first, ["folder", F.lower("path"), "path"], place="ord")


def digests(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, size and sha256 of files, as a manifest."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return rows.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def fingerprints(files: DataFrame, chunk: int = 8 << 20) -> DataFrame:
    """block, bytes and sha256 of files (block, path), read as streams where Spark puts the rows; a file may be of any size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for block, path in zip(frame["block"], frame["path"], strict=True):
                digest, size = hashlib.sha256(), 0
                store, name = opened(path)
                with store.open_input_stream(name) as stream:
                    while data := stream.read(chunk):
                        digest.update(data)
                        size += len(data)
                out.append((block, size, digest.hexdigest()))
            yield pd.DataFrame(out, columns=["block", "bytes", "sha256"])

    return files.repartition("block").mapInPandas(run, "block string, bytes long, sha256 string")
