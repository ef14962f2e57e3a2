"""SQLite containers (MBTiles, GeoPackage) as a Spark data source, and tile sets as a sink.

`spark.read.format("sqlite").option("table", "tiles").schema(...).load(path)` reads the columns of the schema; without
a schema they are found from the table. Partitions are ranges of rowid. The file must be where every task
can open it.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import shutil
import sqlite3
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from gridloom.sources.files import opened


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://').removeprefix('file:')}?mode=ro", uri=True)


def _kind(declared: str):
    declared = (declared or "").upper()
    if "INT" in declared:
        return LongType()
    if "BLOB" in declared:
        return BinaryType()
    return DoubleType() if any(x in declared for x in ("REAL", "DOUB", "FLOA")) else StringType()


class _Range(InputPartition):
    def __init__(self, low, high):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.columns = options["path"], options["table"].replace('"', '""'), [f.name.replace('"', '""') for f in schema]
        self.parts = int(options.get("partitions", 8))

    def partitions(self):
        with _connect(self.path) as db:
            try:
                low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
            except sqlite3.OperationalError:  # a view or a table without rowid is one part
                return [_Range(None, None)]
        if low is None:
            return [_Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, part):
        names = ", ".join(f'"{c}"' for c in self.columns)
        with _connect(self.path) as db:
            some, args = ("", ()) if part.low is None else (" where rowid >= ? and rowid < ?", (part.low, part.high))
            yield from db.execute(f'select {names} from "{self.table}"{some}', args)


class SqliteDataSource(DataSource):
    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self):
        with _connect(self.options["path"]) as db:
            found = db.execute(f"select name, type from pragma_table_info('{self.options['table']}')").fetchall()
        return StructType([StructField(n, _kind(t)) for n, t in found])

    def reader(self, schema):
        return SqliteReader(self.options, schema)


class _Set(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class TileSetWriter(DataSourceWriter):
    """A file .mbtiles per tile set from rows (tile_set, zoom_level, tile_column, tile_row, tile_data) sorted by set: one task fills one, row by row, in a file of its own folder and
    sends it on whole. Rows of one place keep the last. Options: metadata, a JSON object of names and values for all sets. Either all files appear or none."""

    def __init__(self, options):
        self.options, self.job = options, uuid.uuid4().hex

    def write(self, iterator):
        store, root = opened(self.options["path"])
        store.create_dir(f"{root}/_{self.job}", recursive=True)
        names = []
        with tempfile.TemporaryDirectory() as folder:
            for name, rows in itertools.groupby(iterator, key=lambda r: r.tile_set):
                local = f"{folder}/{uuid.uuid4().hex}"
                with contextlib.closing(sqlite3.connect(local)) as db, db:
                    db.execute("create table metadata (name text, value text)")
                    db.executemany("insert into metadata values (?, ?)", json.loads(self.options.get("metadata", "{}")).items())
                    db.execute("create table tiles (zoom_level integer, tile_column integer, tile_row integer, tile_data blob, unique (zoom_level, tile_column, tile_row) on conflict replace)")
                    db.executemany("insert into tiles values (?, ?, ?, ?)", ((r.zoom_level, r.tile_column, r.tile_row, bytes(r.tile_data)) for r in rows))
                names.append((f"{name}.mbtiles", uuid.uuid4().hex))
                with open(local, "rb") as source, store.open_output_stream(f"{root}/_{self.job}/{names[-1][1]}") as out:
                    shutil.copyfileobj(source, out, 8 << 20)
        return _Set(names)

    def commit(self, messages):
        store, root = opened(self.options["path"])
        for name, made in (x for m in messages if m for x in m.names):
            store.move(f"{root}/_{self.job}/{made}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages):
        store, root = opened(self.options["path"])
        if store.get_file_info(f"{root}/_{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_{self.job}")


class TileSetDataSource(DataSource):
    @classmethod
    def name(cls):
        return "tileset"

    def schema(self):
        return "tile_set string, zoom_level int, tile_column long, tile_row long, tile_data binary"

    def writer(self, schema, overwrite):
        return TileSetWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteDataSource)
    spark.dataSource.register(TileSetDataSource)


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    register(spark)
    return spark.read.format("sqlite").option("table", name).load(path)


def zoom_payload(tiles: DataFrame) -> DataFrame:
    """Tiles and stored bytes of each zoom level."""
    return tiles.groupBy("zoom_level").agg(F.count("*").alias("tiles"), F.sum(F.octet_length("tile_data")).alias("bytes"))


def layers(contents: DataFrame, themes: list[str], scales: list[int]) -> DataFrame:
    """Names of the theme by scale matrix, with whether a contents table (table_name) has each."""
    spark = contents.sparkSession
    wanted = spark.createDataFrame([(t, s, f"world_{t}_{s}") for t in themes for s in scales], "theme string, scale int, table_name string")
    return wanted.join(contents.select("table_name").distinct().withColumn("there", F.lit(True)), "table_name", "left").withColumn("there", F.coalesce("there", F.lit(False)))
