"""The folder that driver and executors share, and the intermediate tables in it."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Intermediate tables of the scope that the caller is in: path, and name in the catalogue where it has one. Threads have scopes of their own.
_made: contextvars.ContextVar[list[tuple[str, str | None]] | None] = contextvars.ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where that is unset on one machine, as in tests."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str | None = None) -> str:
    """A new path in the shared folder, for a table that the catalogue knows by `name`; the scope that it is asked for in deletes it."""
    path = f"{shared_dir(spark)}/gridloom/{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append((path, name))
    return path


def written(df: DataFrame, **options) -> DataFrame:
    """`df` as a Parquet table of the shared folder, written with options: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to as many tasks as a shuffle has, for work that is long for what it reads: a small file is one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def delete(spark: SparkSession, path: str, name: str | None = None) -> None:
    if name is not None:
        spark.sql(f"drop table if exists {name}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the intermediate tables that operators called inside it have made. What reads them must have run by then.

    Scopes nest, and each deletes its own; outside of any, tables stay for whoever cleans the shared folder.
    """
    before = _made.set([])
    try:
        yield
    finally:
        made = _made.get() or []
        _made.reset(before)
        for path, name in made:
            delete(spark, path, name)
