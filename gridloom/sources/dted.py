"""DTED elevation cells as a Spark data source and sink: a row per post, or per file from its header alone.

Posts come as path, factor, band, x (column in the cell), y (row from the north), v and valid; files as path,
west, south, level, rows, columns, factor. The format is fixed: text headers, then a record per column from
west to east with its posts from south to north as big-endian numbers of sign and magnitude. The sink takes a row
(path, west, south, x, posts from the north as array<int>) per column, sorted by path and x, and writes a file per path, of which all appear or none.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from gridloom.sources.files import opened

POSTS = "path string, factor int, band int, x long, y long, v double, valid boolean"
CELLS = "path string, west int, south int, level int, rows int, columns int, factor int"
#: Bytes of the three headers, and of a record besides its posts; the value that stands for no data.
HEADERS, RECORD, NODATA = (80, 648, 2700), 12, -32767
FACTORS = (1, 2, 3, 4, 6)


def degrees(text: str) -> int:
    """DDDMMSSH of a corner on a whole degree."""
    value = int(text[:3])
    return -value if text[7] in "WS" else value


#: Bytes of files that share a partition, and of one file in units of what opening it costs.
SHARED_BYTES, OPEN_BYTES = 32 << 20, 256 << 10


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class DtedReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        store, path = opened(self.options["path"])
        level = self.options.get("level")
        suffixes = (f".dt{level}",) if level is not None else (".dt0", ".dt1", ".dt2")
        part = self.options.get("contains", "").lower()
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == fs.FileType.Directory else [store.get_file_info(path)]
        named = sorted(((x.path, x.size) for x in found if x.is_file and x.path.lower().endswith(suffixes) and part in x.base_name.lower()), key=lambda p: (p[0].lower(), p))
        out, held = [], 0
        for path, size in named:
            size = OPEN_BYTES if self.options.get("mode") == "metadata" else size + OPEN_BYTES
            if out and held + size <= SHARED_BYTES:
                out[-1].paths.append(path)
                held += size
            else:
                out.append(_Part([path]))
                held = size
        return out or [_Part([])]

    def read(self, part):
        store, _ = opened(self.options["path"])
        for path in part.paths:
            yield from self._cell(store, path)

    def _cell(self, store, path):
        with store.open_input_file(path) as stream:
            head = stream.read(80).decode("ascii")
            if not head.startswith("UHL1"):
                raise ValueError(f"{path} isn't DTED")
            west, south, columns, rows = degrees(head[4:12]), degrees(head[12:20]), int(head[47:51]), int(head[51:55])
            factor = round((rows - 1) / (columns - 1))
            if factor not in FACTORS or (columns - 1) * factor != rows - 1:
                raise ValueError(f"{path}: {columns} columns don't fit {rows} rows")
            if self.options.get("mode") == "metadata":
                level = int(path[-1])
                yield path, west, south, level, rows, columns, factor
                return
            stream.seek(sum(HEADERS))
            raw = np.frombuffer(stream.read(columns * (RECORD + 2 * rows)), np.uint8).reshape(columns, -1)
            words = raw[:, 8 : 8 + 2 * rows].copy().view(">u2").astype(np.int32)
            v = np.where(words & 0x8000, -(words & 0x7FFF), words)[:, ::-1].T
            n = rows * columns
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * n), pa.array(np.full(n, factor, np.int32)), pa.array(np.ones(n, np.int32)), pa.array(np.tile(np.arange(columns), rows)), pa.array(np.repeat(np.arange(rows), columns)),
                    pa.array(v.ravel().astype(np.float64)), pa.array(v.ravel() != NODATA),
                ],
                ["path", "factor", "band", "x", "y", "v", "valid"],
            )


def column(x: int, posts: np.ndarray) -> bytes:
    """The record of a column: its number, its posts from the south, and the sum of its bytes."""
    v = posts[::-1].astype(np.int64)
    if (np.abs(v) > 32767).any():
        raise ValueError("a post is beyond 32767")
    body = struct.pack(">BBHHH", 0xAA, 0, x, x, 0) + np.where(v < 0, 0x8000 | -v, v).astype(">u2").tobytes()
    return body + struct.pack(">I", sum(body))


def header(west: int, south: int, columns: int, rows: int) -> bytes:
    """The three headers, of which the first says all that is read: corner, intervals in tenths of seconds, size."""
    corner = lambda v, ways: f"{abs(v):03d}0000{ways[v < 0]}"
    tenths = lambda n: f"{min(9999, round(36000 / max(n - 1, 1))):04d}"  # noqa: E731  four digits hold no wider ones
    first = f"UHL1{corner(west, 'EW')}{corner(south, 'NS')}{tenths(columns)}{tenths(rows)}NA  U  {'':12}{columns:04d}{rows:04d}0".ljust(HEADERS[0])
    return (first + "DSI".ljust(HEADERS[1]) + "ACC".ljust(HEADERS[2])).encode("ascii")


class _Files(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class DtedWriter(DataSourceWriter):
    def __init__(self, options):
        self.options, self.job = options, uuid.uuid4().hex

    def write(self, iterator):
        store, root = opened(self.options["path"])
        store.create_dir(f"{root}/_{self.job}", recursive=True)
        names, held, facts = [], [], None

        def put():
            if [x for x, _ in held] != list(range(len(held))):
                raise ValueError(f"{facts[0]} has not every column once")
            names.append((facts[0], uuid.uuid4().hex))
            with store.open_output_stream(f"{root}/_{self.job}/{names[-1][1]}") as out:
                out.write(header(facts[1], facts[2], len(held), facts[3]))
                for _, record in held:
                    out.write(record)

        for row in iterator:
            mine = (row.path, row.west, row.south, len(row.posts))
            if facts is not None and mine != facts:
                if mine[0] == facts[0]:
                    raise ValueError(f"{facts[0]} has columns of different lengths or corners")
                put()
                held = []
            facts = mine
            held.append((row.x, column(row.x, np.array(row.posts))))
        if facts is not None:
            put()
        return _Files(names)

    def commit(self, messages):
        store, root = opened(self.options["path"])
        for name, made in (x for m in messages if m for x in m.names):
            store.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
            store.move(f"{root}/_{self.job}/{made}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages):
        store, root = opened(self.options["path"])
        if store.get_file_info(f"{root}/_{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_{self.job}")


class DtedDataSource(DataSource):
    @classmethod
    def name(cls):
        return "dted"

    def schema(self):
        return CELLS if self.options.get("mode") == "metadata" else POSTS

    def reader(self, schema):
        return DtedReader(self.options)

    def writer(self, schema, overwrite):
        return DtedWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DtedDataSource)
