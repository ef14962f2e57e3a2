"""Shapefiles as a Spark data source and sink.

`spark.read.format("shapefile").load(path)` gives a row per record of each .shp at the path: path, record, kind (point, line or polygon),
xmin, ymin, xmax, ymax, parts (rings or lines of points) and fields (the .dbf row as text; empty values are null). Ranges of records are dealt to tasks by the size of the
index .shx alone. Comparisons of record, xmin, ymin, xmax and ymax are pushed down: a record's box is read from its first bytes, and neither the points nor the .dbf row of one
that can't pass are read. `df.write.format("shapefile")` writes a shapefile per task from parts and fields; null or empty parts are null shapes.
"""

from __future__ import annotations

import operator
import struct
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from gridloom.sources.files import opened

SCHEMA = "path string, record long, kind string, xmin double, ymin double, xmax double, ymax double, parts array<array<struct<x double, y double>>>, fields map<string,string>"
#: Fixed values of the format: shape types without and with further ordinates, and the bytes of a box.
KINDS = {1: "point", 3: "line", 5: "polygon", 8: "points", 11: "point", 13: "line", 15: "polygon", 18: "points", 21: "point", 23: "line", 25: "polygon", 28: "points"}
CODES = {"point": 1, "line": 3, "polygon": 5}
#: Records that a task reads.
RECORDS = 50_000
_TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class _Part(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class _Table:
    """Rows of a .dbf by number, as text."""

    def __init__(self, stream):
        self.stream = stream
        head = stream.read(32)
        self.rows, self.start, self.size = struct.unpack("<IHH", head[4:12])
        raw = stream.read(self.start - 32)
        self.fields, at = [], 1
        for i in range(0, len(raw) - 31, 32):
            if raw[i] == 0x0D:
                break
            name, width = raw[i : i + 11].split(b"\0")[0].decode("latin-1"), raw[i + 16]
            self.fields.append((name, at, at + width))
            at += width

    def row(self, n: int) -> dict[str, str | None]:
        if n >= self.rows:
            return {}
        self.stream.seek(self.start + n * self.size)
        raw = self.stream.read(self.size)
        return {name: raw[a:b].decode("utf-8", "replace").strip(" \0") or None for name, a, b in self.fields}


class ShapefileReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.tests = options, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in ("record", "xmin", "ymin", "xmax", "ymax") and type(f) in _TESTS and f.value is not None:
                self.tests.append((name, _TESTS[type(f)], f.value))
            else:
                yield f

    def _passes(self, **known) -> bool:
        return all(known[name] is not None and test(known[name], value) for name, test, value in self.tests if name in known)

    def partitions(self):
        store, path = opened(self.options["path"])
        info = store.get_file_info(path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        step, out = int(self.options.get("records_per_partition", RECORDS)), []
        for name in sorted(x.path for x in found if x.is_file and x.path.lower().endswith(".shp")):
            n = (store.get_file_info(name[:-1] + ("x" if name[-1] == "p" else "X")).size - 100) // 8
            out += [_Part(name, i, min(i + step, n)) for i in range(0, n, step)]
        return out or [_Part("", 0, 0)]

    def read(self, part):
        if part.first == part.last:
            return
        store, _ = opened(self.options["path"])
        upper = part.path[-1] == "P"
        with store.open_input_file(part.path[:-1] + ("X" if upper else "x")) as stream:
            stream.seek(100 + 8 * part.first)
            index = struct.unpack(f">{2 * (part.last - part.first)}i", stream.read(8 * (part.last - part.first)))
        table = store.get_file_info(part.path[:-3] + ("DBF" if upper else "dbf"))
        with store.open_input_file(part.path) as shapes:
            attributes = _Table(store.open_input_file(table.path)) if table.is_file else None
            for k in range(part.last - part.first):
                if not self._passes(record=part.first + k):
                    continue
                shapes.seek(2 * index[2 * k] + 8)
                size = 2 * index[2 * k + 1]
                head = shapes.read(min(size, 44))
                code = struct.unpack("<i", head[:4])[0]
                kind = KINDS.get(code)
                if kind is None:
                    box, parts = (None,) * 4, []
                elif kind == "point":
                    x, y = struct.unpack("<2d", head[4:20])
                    box, parts = (x, y, x, y), [[(x, y)]]
                else:
                    box = struct.unpack("<4d", head[4:36])
                if not self._passes(xmin=box[0], ymin=box[1], xmax=box[2], ymax=box[3]):
                    continue
                if kind not in (None, "point"):
                    parts = self._points(kind, head + shapes.read(size - len(head)))
                yield part.path, part.first + k, kind, *box, parts, attributes.row(part.first + k) if attributes else {}
            if attributes:
                attributes.stream.close()

    @staticmethod
    def _points(kind: str, raw: bytes) -> list[list[tuple[float, float]]]:
        if kind == "points":
            n = struct.unpack("<i", raw[36:40])[0]
            flat = struct.unpack(f"<{2 * n}d", raw[40 : 40 + 16 * n])
            return [[p] for p in zip(flat[::2], flat[1::2], strict=True)]
        m, n = struct.unpack("<2i", raw[36:44])
        starts = [*struct.unpack(f"<{m}i", raw[44 : 44 + 4 * m]), n]
        flat = struct.unpack(f"<{2 * n}d", raw[44 + 4 * m : 44 + 4 * m + 16 * n])
        points = list(zip(flat[::2], flat[1::2], strict=True))
        return [points[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def shape(code: int, parts) -> tuple[bytes, tuple[float, float, float, float] | None]:
    """The content of a record, and its box; no parts give a null shape."""
    points = [(p[0], p[1]) for part in parts or () for p in part]
    if not points:
        return struct.pack("<i", 0), None
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    box = min(xs), min(ys), max(xs), max(ys)
    if code == 1:
        return struct.pack("<i2d", 1, *points[0]), box
    starts, at = [], 0
    for part in parts:
        starts.append(at)
        at += len(part)
    return struct.pack(f"<i4d2i{len(starts)}i{2 * at}d", code, *box, len(starts), at, *starts, *[v for p in points for v in p]), box


class _Files(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class ShapefileWriter(DataSourceWriter):
    """Options: kind (point, line, polygon), fields (names, up to ten letters each, by commas), width (bytes of a field, 80).

    A task's records are held until their number, length and box are known, which the files begin with; so their number is bounded by that of a partition.
    Texts beyond a field's width raise. Either all files appear or none.
    """

    def __init__(self, options):
        self.options, self.job = options, uuid.uuid4().hex

    def write(self, iterator):
        code, width = CODES[self.options.get("kind", "polygon")], int(self.options.get("width", 80))
        names = [n for n in self.options.get("fields", "").split(",") if n]
        content, index, rows, boxes, at = [], [], [], [], 50
        for n, row in enumerate(iterator, 1):
            body, box = shape(code, row.parts)
            boxes += [box] if box else []
            index.append(struct.pack(">2i", at, len(body) // 2))
            content.append(struct.pack(">2i", n, len(body) // 2) + body)
            at += 4 + len(body) // 2
            cells = [((row.fields or {}).get(name) or "").encode() for name in names]
            if any(len(c) > width for c in cells):
                raise ValueError(f"a text of record {n} is longer than a field's {width} bytes")
            rows.append(b" " + b"".join(c.ljust(width) for c in cells))
        if not rows:
            return _Files([])
        whole = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else (0.0,) * 4
        head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, code, *whole, 0, 0, 0, 0)
        fields = b"".join(name.encode()[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([width, 0]) + bytes(14) for name in names)
        table = struct.pack("<4BIHH", 3, 95, 7, 26, len(rows), 33 + len(fields), 1 + width * len(names)) + bytes(20) + fields + b"\r" + b"".join(rows) + b"\x1a"
        store, path = opened(self.options["path"])
        store.create_dir(f"{path}/_{self.job}", recursive=True)
        stem = uuid.uuid4().hex
        for suffix, data in (("shp", [head(at), *content]), ("shx", [head(50 + 4 * len(index)), *index]), ("dbf", [table])):
            with store.open_output_stream(f"{path}/_{self.job}/{stem}.{suffix}") as out:
                for d in data:
                    out.write(d)
        return _Files([f"{stem}.{s}" for s in ("dbf", "shx", "shp")])

    def commit(self, messages):
        store, path = opened(self.options["path"])
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{path}/_{self.job}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages):
        store, path = opened(self.options["path"])
        if store.get_file_info(f"{path}/_{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/_{self.job}")


class ShapefileDataSource(DataSource):
    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ShapefileReader(self.options)

    def writer(self, schema, overwrite):
        return ShapefileWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
