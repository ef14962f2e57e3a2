"""GeoTIFF as a Spark data source and sink.

`spark.read.format("geotiff").load(path)` gives a row per stored tile: path, band, x, y, w, h, samples (doubles in
reading order) and valid (a byte each). With option samples=stored, samples have the file's type (little endian) and
valid is a bit each, most significant first, or null where all are. Samples are valid where the file's mask (a mask directory, or a file
.msk beside it) says so and they aren't its NoData value; with strict=true a NoData value that the mask calls valid raises.
Option mode=metadata gives a row per file from its header alone; option
window=x,y,w,h, box=west,south,east,north (in coordinates, for each file its own window) and files=[paths] in JSON plan only the tiles that meet it, and so do filters on path, band, x and y, which are pushed down to
the stored tiles. Small files share a partition, a large one is dealt to several by shares of its tiles; none is
opened to plan that. `df.write.format("geotiff")` takes rows (block, band, tx, ty, samples) sorted by block and
writes a file per block: all directories first, then the tiles of the smallest overview up to the raster's own.
"""

from __future__ import annotations

import hashlib
import json
import lzma
import math
import operator
import struct
import uuid
import xml.etree.ElementTree as ET
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from gridloom.sources.files import opened

TILES = "path string, band int, x long, y long, w int, h int, samples binary, valid binary"
METADATA = (
    "path string, width long, height long, bands int, dtype string, nodata double, c double, a double, b double, f double, d double, e double, "
    "compression string, predictor int, tile_width int, tile_height int, tiles int, stored_bytes long, levels int, crs string, alpha boolean, palette boolean, faults array<string>, masked boolean, point boolean, system string, geo string, items map<string,string>"
)
#: Fixed values of the TIFF format: compression codes, sample formats, sizes of field types.
CODECS = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773, "lzma": 34925, "zstd": 50000}
KINDS = {1: "u", 2: "i", 3: "f"}
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NAMES = {code: name for name, code in CODECS.items()} | {32946: "deflate"}


def directories(stream) -> list[dict[int, tuple]]:
    """The tags of each directory of a classic or big TIFF, with its place under "at"."""
    head = stream.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("not a TIFF")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    out = []
    while at:
        stream.seek(at)
        n = struct.unpack(order + ("Q" if big else "H"), stream.read(8 if big else 2))[0]
        step, inline = (20, 8) if big else (12, 4)
        raw = stream.read(n * step + (8 if big else 4))
        tags = {}
        for i in range(n):
            entry = raw[i * step : (i + 1) * step]
            tag, kind = struct.unpack(order + "HH", entry[:4])
            count = struct.unpack(order + ("Q" if big else "I"), entry[4 : step - inline])[0]
            form = FIELDS.get(kind)
            if form is None:
                continue
            size = struct.calcsize("=" + form) * count
            data = entry[step - inline :][:size]
            if size > inline:
                stream.seek(struct.unpack(order + ("Q" if big else "I"), entry[step - inline :])[0])
                data = stream.read(size)
            tags[tag] = (data,) if form == "s" else struct.unpack(f"{order}{count * len(form)}{form[0]}", data)
        tags["order"], tags["at"] = order, at
        out.append(tags)
        at = struct.unpack(order + ("Q" if big else "I"), raw[n * step :])[0]
    return out


def described(tags: dict) -> dict:
    """What a directory tells of its raster; strips count as tiles of the full width."""
    width, height, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    tw, th = (tags[322][0], tags[323][0]) if 322 in tags else (width, min(tags.get(278, (height,))[0], height))
    kind = KINDS[tags.get(339, (1,))[0]]
    bits = tags[258][0] if 258 in tags else 1
    scale, tie = tags.get(33550), tags.get(33922)
    if 34264 in tags:
        m = tags[34264]
        grid = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif scale and tie:
        grid = (tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1])
    else:
        grid = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    if is_point(tags):  # the place given is the middle of the first pixel
        grid = (grid[0] - (grid[1] + grid[2]) / 2, grid[1], grid[2], grid[3] - (grid[4] + grid[5]) / 2, grid[4], grid[5])
    nodata = tags[42113][0].rstrip(b"\0 ").decode() if 42113 in tags else None
    return {
        "width": width, "height": height, "bands": bands, "dtype": f"{tags['order']}{kind}{max(1, bits // 8)}", "nodata": float(nodata) if nodata else None, "grid": grid,
        "codec": NAMES.get(tags.get(259, (1,))[0]), "predictor": tags.get(317, (1,))[0], "tile": (tw, th), "planar": tags.get(284, (1,))[0],
        "offsets": tags.get(324) or tags.get(273), "counts": tags.get(325) or tags.get(279), "strips": 322 not in tags, "bits": bits,
    }


def images(levels: list[dict]) -> tuple[list[dict], list[dict]]:
    """The directories of a raster and its overviews, and those of masks."""
    mask = lambda tags: bool(tags.get(254, (0,))[0] & 4)
    return [x for x in levels if not mask(x)], [x for x in levels if mask(x)]


def _keys(tags: dict) -> dict[int, object]:
    """The values of the GeoKeys, wherever they are kept."""
    keys, out = tags.get(34735) or (), {}
    for i in range(4, len(keys) - 3, 4):
        key, at, n, value = keys[i : i + 4]
        if at == 34736:
            value = list(tags.get(34736, ())[value : value + n])
        elif at == 34737:
            value = tags.get(34737, (b"",))[0][value : value + n].decode("latin-1").rstrip("|\0 ")
        out[key] = value
    return out


def is_point(tags: dict) -> bool:
    return _keys(tags).get(1025) == 2


def reference_system(tags: dict) -> str | None:
    """EPSG code of the GeoKeys, else the name that they give a system of their own, else none."""
    found = _keys(tags)
    for key in (3072, 2048):  # projected, geographic
        if found.get(key) not in (None, 0, 32767):
            return f"EPSG:{found[key]}"
    return next((found[key] for key in (3073, 1026, 2049) if found.get(key)), None)  # names


def system(tags: dict) -> str | None:
    """What tells coordinate systems apart: the EPSG code, else all GeoKeys but for names and what a pixel is; none without keys."""
    found, named = _keys(tags), reference_system(tags)
    if not found or named is not None and named.startswith("EPSG:"):
        return named if found else None
    return json.dumps({str(k): v for k, v in sorted(found.items()) if k not in (1025, 1026, 2049, 3073)}, sort_keys=True)


def geo_tags(tags: dict) -> str | None:
    """The tags of the GeoKeys as they are, for a writer's option `geo`."""
    kept = {str(t): tags[t][0].decode("latin-1") if t == 34737 else list(tags[t]) for t in (34735, 34736, 34737) if t in tags}
    return json.dumps(kept) if "34735" in kept else None


def metadata_items(tags: dict) -> dict[str, str]:
    """The items of the metadata tag (XML), which also holds scales, offsets, units and descriptions; by name, band and role."""
    text = tags[42112][0].rstrip(b"\0").decode("utf-8", "replace") if 42112 in tags else ""
    if not text or "<!DOCTYPE" in text.upper() or "<!ENTITY" in text.upper():
        return {}
    items = ET.fromstring(text).iter("Item")
    return {"|".join(x for x in (i.get("name", ""), i.get("sample"), i.get("role")) if x is not None): i.text or "" for i in items}


#: EPSG codes whose kind is known without a register: geographic ones, and ranges of projected ones.
GEOGRAPHIC = (4258, 4267, 4269, 4283, 4326, 6318, 7844)
PROJECTED = ((3857, 3857), (25828, 25838), (26901, 26923), (32601, 32660), (32701, 32760))


def geo_keys(crs: str, kind: str | None = None) -> list[int]:
    """The GeoKeys of an EPSG code, which is geographic or projected. Pixels are areas."""
    code = int(crs.upper().removeprefix("EPSG:"))
    kind = kind or ("geographic" if code in GEOGRAPHIC else "projected" if any(a <= code <= b for a, b in PROJECTED) else None)
    if kind not in ("geographic", "projected"):
        raise ValueError(f"say with option crs_kind whether EPSG:{code} is geographic or projected")
    geographic = kind == "geographic"
    return [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, code]


def representable(value: float, dtype: str) -> bool:
    """Whether a type holds a number as it is; NaN only fits floating ones."""
    kind = np.dtype(dtype)
    if kind.kind == "f":
        with np.errstate(over="ignore"):
            return value != value or float(kind.type(value)) == value
    return value == value and value == int(value) and np.iinfo(kind).min <= value <= np.iinfo(kind).max if abs(value) != float("inf") else False


def structure_faults(levels: list[dict], edge: int = 512) -> list[str]:
    """What keeps a file from being cloud optimised: tiles, overviews that halve, directories first, small levels before large."""
    faults, found = [], [described(x) for x in images(levels)[0]]
    if any(d["strips"] and max(d["width"], d["height"]) > edge for d in found):
        faults.append("not tiled")
    if max(found[0]["width"], found[0]["height"]) > edge and len(found) < 2:
        faults.append("no overviews")
    sizes = [(d["width"], d["height"]) for d in found]
    if any(b[0] >= a[0] and b[1] >= a[1] for a, b in zip(sizes, sizes[1:], strict=False)):
        faults.append("overviews don't shrink")
    first = [min((o for o, n in zip(d["offsets"], d["counts"], strict=True) if n), default=None) for d in found]
    if any(at is not None and at < max(x["at"] for x in levels) for at in first):
        faults.append("tiles before directories")
    known = [at for at in first if at is not None]
    if known != sorted(known, reverse=True):
        faults.append("large levels before small ones")
    return faults


def _unpack_lzw(data: bytes) -> bytes:
    """Codes become words of a table that grows by one each: all codes between two clearings are read at once, as their widths follow from their number."""
    flat, out, at = np.unpackbits(np.frombuffer(data, np.uint8)), [], 9
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    if len(flat) < 9 or np.packbits(flat[:9]).tolist() != [128, 0]:
        raise ValueError("an LZW stream doesn't begin with a clearing")
    while True:
        codes = _codes(flat, at)
        ends = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(ends[0]) if len(ends) else len(codes)
        table, last = list(first), b""
        for code in codes[:n].tolist():
            word = table[code] if code < len(table) else last + last[:1]
            out.append(word)
            if last:
                table.append(last + word[:1])
            last = word
        if n == len(codes) or codes[n] == 257:
            return b"".join(out)
        at += int(_STARTS[n + 1])


def _width(entries: int) -> int:
    """Bits of the code that is written when the table has so many entries; one earlier than they would be needed."""
    return 9 if entries < 511 else 10 if entries < 1023 else 11 if entries < 2047 else 12


#: Widths of the codes after a clearing, of which there are at most 3,838: the first adds no entry.
_WIDTHS = np.array([_width(258 + max(0, k - 1)) for k in range(4096)])
_STARTS = np.concatenate([[0], np.cumsum(_WIDTHS)])


def _codes(flat: np.ndarray, at: int) -> np.ndarray:
    """The codes after a clearing, as far as the table can grow or the bits reach."""
    starts, widths = at + _STARTS[:-1], _WIDTHS
    there = starts + widths <= len(flat)
    starts, widths = starts[there], widths[there]
    out = np.zeros(len(starts), np.int64)
    for k in range(12):
        some = widths > k
        out[some] = out[some] << 1 | flat[starts[some] + k]
    return out


def _pack_lzw(data: bytes) -> bytes:
    """Codes of the longest words that the table has, each with its next byte becoming an entry; cleared when it is full."""
    codes, widths = [256], [9]
    table, following, word = {}, 258, -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        longer = table.get(word << 8 | byte)
        if longer is not None:
            word = longer
            continue
        codes.append(word)
        widths.append(_width(max(258, following - 1)))
        table[word << 8 | byte] = following
        following += 1
        word = byte
        if following == 4094:
            codes.append(256)
            widths.append(12)
            table, following = {}, 258
    if word >= 0:
        codes.append(word)
        widths.append(_width(max(258, following - 1)))
        following += 1
    codes.append(257)
    widths.append(_width(max(258, following - 1)))
    code, width = np.array(codes), np.array(widths)
    bits = (code[:, None] >> np.arange(11, -1, -1)) & 1
    return np.packbits(bits[np.arange(12) >= 12 - width[:, None]].astype(np.uint8)).tobytes()


def _unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def _pack_bits(data: bytes) -> bytes:
    """Runs of three and more as repeats, the rest as literals."""
    x = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(x)) + 1
    start = np.concatenate([[0], edge]) if len(x) else edge
    size = np.diff(np.concatenate([start, [len(x)]]))
    out, literal = bytearray(), bytearray()

    def flush():
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for s, n in zip(start.tolist(), size.tolist(), strict=True):
        if n < 3:
            literal.extend(data[s : s + n])
            continue
        flush()
        while n:
            k = min(n, 128)
            out.extend((257 - k, data[s]) if k > 1 else (0, data[s]))
            n -= k
    flush()
    return bytes(out)


def decoded(raw: bytes, codec: str, size: int) -> bytes:
    if codec == "none":
        return raw
    if codec == "deflate":
        return zlib.decompress(raw)
    if codec == "zstd":
        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)
    if codec == "lzma":
        return lzma.decompress(raw)
    if codec in ("packbits", "lzw"):
        return (_unpack_bits if codec == "packbits" else _unpack_lzw)(raw)
    raise ValueError(f"compression {codec} isn't supported")


def encoded(data: bytes, codec: str, level: int | None) -> bytes:
    if codec == "none":
        return data
    if codec == "deflate":
        return zlib.compress(data, 6 if level is None else level)
    if codec == "zstd":
        return zstandard.ZstdCompressor(level=9 if level is None else level).compress(data)
    if codec == "lzma":
        return lzma.compress(data, preset=6 if level is None else level)
    if codec in ("packbits", "lzw"):
        return (_pack_bits if codec == "packbits" else _pack_lzw)(data)
    raise ValueError(f"compression {codec} can't be written")


def differenced(x: np.ndarray, predictor: int) -> bytes:
    """Predictor 2 keeps differences of whole samples along rows, 3 those of bytes, most significant planes first."""
    if predictor == 2:
        whole = x.view(f"<u{x.itemsize}")
        return np.concatenate([whole[:, :1], np.diff(whole, axis=1)], axis=1).tobytes()
    if predictor == 3:
        planes = x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(*x.shape, x.itemsize).transpose(0, 2, 1).reshape(len(x), -1)
        return np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).tobytes()
    return x.tobytes()


def restored(data: bytes, dtype: str, w: int, h: int, planes: int, predictor: int, bits: int = 8) -> np.ndarray:
    kind = np.dtype(dtype)
    if bits == 1:
        return np.unpackbits(np.frombuffer(data, np.uint8).reshape(h, -1), axis=1)[:, : w * planes].reshape(h, w, planes)
    if predictor == 2:
        whole = np.frombuffer(data, f"{dtype[0]}u{kind.itemsize}")[: w * h * planes].reshape(h, w, planes)
        x = np.cumsum(whole, axis=1, dtype=whole.dtype.newbyteorder("="))
        return x.view(kind.newbyteorder("=")).reshape(h, w, planes)
    if predictor == 3:
        flat = np.cumsum(np.frombuffer(data, np.uint8).reshape(h, -1), axis=1, dtype=np.uint8)
        x = np.ascontiguousarray(flat.reshape(h, kind.itemsize, w * planes).transpose(0, 2, 1))
        return x.view(f">f{kind.itemsize}").reshape(h, w, planes)
    return np.frombuffer(data, kind)[: w * h * planes].reshape(h, w, planes)


class _Part(InputPartition):
    """Files, or the share-th of several shares of the tiles of one."""

    def __init__(self, paths: list[str], share: int = 0, shares: int = 1):
        super().__init__((paths, share, shares))
        self.paths, self.share, self.shares = paths, share, shares


#: Bytes of files that share a partition, and of a share of a larger one; option partition_bytes.
SHARED_BYTES = 8 << 20
#: Bytes of samples in a batch of rows.
BATCH_BYTES = 4 << 20
_TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def _bytes(d: dict, rows: int) -> int:
    planes = d["bands"] if d["planar"] == 1 else 1
    return -(-d["tile"][0] * planes // 8) * rows if d["bits"] == 1 else d["tile"][0] * rows * planes * np.dtype(d["dtype"]).itemsize


def stored_tile(stream, d: dict, i: int) -> np.ndarray:
    """The i-th stored tile or strip of a directory, rows by columns by planes; one that isn't stored is of NoData, or zeros."""
    (tw, th), across = d["tile"], -(-d["width"] // d["tile"][0])
    down = -(-d["height"] // th)
    planes = d["bands"] if d["planar"] == 1 else 1
    rows = min(th, d["height"] - i % (across * down) // across * th) if d["strips"] else th
    if not d["counts"][i]:
        return np.full((rows, tw, planes), d["nodata"] or 0, d["dtype"])
    stream.seek(d["offsets"][i])
    data = decoded(stream.read(d["counts"][i]), d["codec"], _bytes(d, rows))
    return restored(data, d["dtype"], tw, rows, planes, d["predictor"], d["bits"])


#: Bytes that a file is asked for first, which hold most headers; gaps between tiles that are read over; the most that one range holds.
HEAD_BYTES, GAP_BYTES, RANGE_BYTES = 64 << 10, 64 << 10, 8 << 20


class Ranges:
    """A file as ranges of bytes: its head is asked for once, and what `fetch` announces in as few ranges as its gaps allow."""

    def __init__(self, stream):
        self.stream, self.at, self.asked = stream, 0, []
        self.held = [(0, self._ask(0, HEAD_BYTES))]

    def _ask(self, start: int, size: int) -> bytes:
        self.asked.append((start, size))
        self.stream.seek(start)
        return self.stream.read(size)

    def fetch(self, places: list[tuple[int, int]]) -> None:
        """Reads places (offset, size) that will be read next, neighbours together."""
        self.held = self.held[:1]
        for start, size in sorted(p for p in places if p[1] and p[0] + p[1] > len(self.held[0][1])):
            if len(self.held) > 1 and start - self.stop <= GAP_BYTES and start + size - self.start <= RANGE_BYTES:
                self.stop = max(self.stop, start + size)
            else:
                if len(self.held) > 1:
                    self.held[-1] = (self.start, self._ask(self.start, self.stop - self.start))
                self.start, self.stop = start, start + size
                self.held.append((start, b""))
        if len(self.held) > 1:
            self.held[-1] = (self.start, self._ask(self.start, self.stop - self.start))

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, size: int) -> bytes:
        start, self.at = self.at, self.at + size
        for first, data in self.held:
            if first <= start and start + size <= first + len(data):
                return data[start - first : start - first + size]
        return self._ask(start, size)


class _Mask:
    """The validity that a mask directory gives windows of the raster; the last tiles that were read are kept."""

    def __init__(self, stream, d: dict):
        self.stream, self.d, self.held = stream, d, {}

    def window(self, band: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        d, (tw, th) = self.d, self.d["tile"]
        across, down = -(-d["width"] // tw), -(-d["height"] // th)
        out = np.zeros((h, w), bool)
        plane = band if d["bands"] > 1 else 0
        for ty in range(y // th, (y + h - 1) // th + 1):
            for tx in range(x // tw, (x + w - 1) // tw + 1):
                at = ty * across + tx + (plane * across * down if d["planar"] != 1 else 0)
                if at not in self.held:
                    if len(self.held) > 8:
                        self.held.pop(next(iter(self.held)))
                    self.held[at] = stored_tile(self.stream, d, at) > 0
                tile = self.held[at][:, :, plane if d["planar"] == 1 else 0]
                a, b, c, e = max(x, tx * tw), min(x + w, (tx + 1) * tw), max(y, ty * th), min(y + h, (ty + 1) * th)
                out[c - y : e - y, a - x : b - x] = tile[c - ty * th : e - ty * th, a - tx * tw : b - tx * tw]
        return out


class GeoTiffReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.tests = options, []
        self.metadata, self.stored, self.strict = options.get("mode") == "metadata", options.get("samples") == "stored", options.get("strict") == "true"
        self.window = tuple(int(v) for v in options["window"].split(",")) if "window" in options else None
        self.box = tuple(float(v) for v in options["box"].split(",")) if "box" in options else None

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if not self.metadata and name in ("path", "band", "x", "y") and type(f) in _TESTS and f.value is not None:
                self.tests.append((name, _TESTS[type(f)], f.value))
            else:
                yield f

    def _passes(self, **known) -> bool:
        return all(test(known[name], value) for name, test, value in self.tests if name in known)

    def _files(self):
        store, path = opened(self.options["path"])
        info = store.get_file_info(path)
        found = store.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
        only = set(json.loads(self.options["files"])) if "files" in self.options else None
        return sorted(((x.path, x.size) for x in found if (only is None or x.path in only) and x.is_file and x.path.lower().endswith((".tif", ".tiff", ".ovr")) and (info.is_file or not x.path.endswith(".ovr")) and self._passes(path=x.path)), key=lambda p: (p[0].lower(), p))

    def partitions(self):
        out, size, most = [], 0, int(self.options.get("partition_bytes", SHARED_BYTES))
        for path, n in self._files():
            if not self.metadata and n > most:
                shares = -(-n // most)
                out += [_Part([path], k, shares) for k in range(shares)]
                size = most
            elif out and out[-1].shares == 1 and size + n <= most:
                out[-1].paths.append(path)
                size += n
            else:
                out.append(_Part([path]))
                size = n
        return out or [_Part([])]

    def read(self, part):
        store, _ = opened(self.options["path"])
        for path in part.paths:
            with store.open_input_file(path) as file:
                stream = Ranges(file)
                beside = store.get_file_info(f"{path}.msk").is_file
                if self.metadata:
                    yield self._facts(path, stream, beside)
                elif beside:
                    with store.open_input_file(f"{path}.msk") as mask:
                        yield from self._batches(self._rows(path, stream, mask, part))
                else:
                    yield from self._batches(self._rows(path, stream, None, part))

    def _window(self, d: dict) -> tuple[int, int, int, int] | None:
        """The window that is asked for, in pixels of this file; of a box in coordinates, what a grid without rotation has of it."""
        if self.box is None:
            return self.window
        (west, south, east, north), (c, a, _, f, _, e) = self.box, d["grid"]
        xs, ys = sorted(((west - c) / a, (east - c) / a)), sorted(((south - f) / e, (north - f) / e))
        x, y = math.floor(xs[0]), math.floor(ys[0])
        return x, y, math.ceil(xs[1]) - x, math.ceil(ys[1]) - y

    def _facts(self, path, stream, beside):
        levels = directories(stream)
        own, masks = images(levels)
        d = described(own[0])
        kind = np.dtype(d["dtype"])
        name = {"u": "uint", "i": "int", "f": "float"}[kind.kind] + str(8 * kind.itemsize)
        alpha, palette = bool({1, 2} & set(own[0].get(338, ()))), own[0].get(262, (1,))[0] == 3
        return (
            path, d["width"], d["height"], d["bands"], name, d["nodata"], *d["grid"], d["codec"], d["predictor"], *d["tile"], len(d["offsets"]), sum(d["counts"]), len(own) - 1, reference_system(own[0]), alpha, palette,
            structure_faults(levels), beside or bool(masks), is_point(own[0]), system(own[0]), geo_tags(own[0]), metadata_items(own[0]),
        )

    @staticmethod
    def _batches(rows):
        types, names = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()], [c.split()[0] for c in TILES.split(", ")]
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[6])
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    def _rows(self, path, stream, beside, part):
        own, masks = images(directories(stream))
        d, nodata = described(own[0]), None
        mask = next((_Mask(stream, m) for m in map(described, masks) if (m["width"], m["height"]) == (d["width"], d["height"])), None)
        if beside is not None:
            mask = _Mask(beside, described(directories(beside)[0]))
        kind, nodata = np.dtype(d["dtype"]), d["nodata"]
        if kind.kind != "f" and kind.itemsize == 8 and not self.stored:
            raise ValueError(f"{path}: doubles don't hold 64-bit integers; read with samples=stored")
        (tw, th), across = d["tile"], -(-d["width"] // d["tile"][0])
        down, n = -(-d["height"] // th), len(d["offsets"])
        planes = d["bands"] if d["planar"] == 1 else 1
        window, wanted = self._window(d), []
        for i in range(n * part.share // part.shares, n * (part.share + 1) // part.shares):
            band, place = (0, i) if planes > 1 or d["bands"] == 1 else divmod(i, across * down)
            ty, tx = divmod(place, across)
            x, y = tx * tw, ty * th
            w, h = min(tw, d["width"] - x), min(th, d["height"] - y)
            if window and not (x < window[0] + window[2] and window[0] < x + w and y < window[1] + window[3] and window[1] < y + h):
                continue
            if not self._passes(x=x, y=y) or planes == 1 and not self._passes(band=band + 1):
                continue
            wanted.append((i, band, x, y, w, h))
        size = 0
        for k, (i, band, x, y, w, h) in enumerate(wanted):
            if size <= 0:  # the next few tiles are asked for together
                ahead = [(d["offsets"][j], d["counts"][j]) for j, *_ in wanted[k:]]
                total = np.cumsum([c for _, c in ahead])
                ahead = ahead[: max(1, int(np.searchsorted(total, RANGE_BYTES, "right")))]
                stream.fetch(ahead)
                size = len(ahead)
            size -= 1
            data = stored_tile(stream, d, i)[:h, :w]
            for k in range(planes):
                if not self._passes(band=band + k + 1):
                    continue
                v = np.ascontiguousarray(data[:, :, k])
                there = np.ones(v.shape, bool) if nodata is None else ~np.isnan(v) if nodata != nodata else v != nodata
                good = there if mask is None else mask.window(band + k, x, y, w, h)
                if mask is not None and nodata is not None:
                    if self.strict and (good & ~there).any():
                        raise ValueError(f"{path}: its mask has NoData values marked valid")
                    good = good & there
                if self.stored:
                    yield path, band + k + 1, x, y, w, h, v.astype(kind.newbyteorder("<"), copy=False).tobytes(), None if good.all() else np.packbits(good).tobytes()
                else:
                    yield path, band + k + 1, x, y, w, h, v.astype(np.float64).tobytes(), good.astype(np.uint8).tobytes()


class _Files(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


def halved(x: np.ndarray, method: str) -> np.ndarray:
    """Half as many samples each way: the mean of the valid ones (NaN is none), or the first of each four."""
    if method == "nearest":
        return x[::2, ::2]
    four = np.stack([x[::2, ::2], x[::2, 1::2], x[1::2, ::2], x[1::2, 1::2]])
    n = (~np.isnan(four)).sum(axis=0)
    return np.where(n > 0, np.nansum(four, axis=0) / np.maximum(n, 1), np.nan)


class _Block:
    """One file in the making: its tiles, encoded as they come, and what its overviews will hold."""

    def __init__(self, options: dict, left: int, top: int):
        o = options
        self.edge, self.bands = int(o["edge"]), int(o["bands"])
        self.kind, self.codec, self.predictor = np.dtype(o.get("dtype", "float64")).newbyteorder("<"), o.get("compression", "deflate"), int(o.get("predictor", 1))
        self.level, self.nodata, self.crs, self.crs_kind = int(o["level"]) if "level" in o else None, o.get("nodata"), o.get("crs"), o.get("crs_kind")
        self.geo = {int(k): v for k, v in json.loads(o["geo"]).items()} if o.get("geo") else None
        self.source = self.kind if o.get("samples") == "stored" else np.dtype(np.float64)
        self.masked, self.mask = o.get("mask") == "yes", {}
        self.fill = float(self.nodata) if self.nodata is not None else 0.0
        if self.nodata is not None and not representable(self.fill, self.kind.name):
            raise ValueError(f"{self.kind.name} can't hold NoData {self.nodata}")
        c, a, b, f, d, e = (float(v) for v in o.get("grid", "0,1,0,0,0,-1").split(","))
        self.grid = [c + left * a + top * b, a, b, f + left * d + top * e, d, e]
        width, height = int(o["width"]), int(o["height"])
        self.sizes = [(min(width, int(o.get("total_width", left + width)) - left), min(height, int(o.get("total_height", top + height)) - top))]
        self.method = o.get("overviews", "none")
        while self.method != "none" and max(self.sizes[-1]) > self.edge:
            self.sizes.append(tuple((n + 1) // 2 for n in self.sizes[-1]))
        self.stored: list[dict] = [{} for _ in self.sizes]
        self.planes: list[dict] = [{} for _ in self.sizes]
        self.big = o.get("bigtiff", "auto")

    def _encoded(self, x: np.ndarray) -> bytes:
        return encoded(differenced(np.ascontiguousarray(x.astype(self.kind)), self.predictor), self.codec, self.level)

    def add(self, band: int, tx: int, ty: int, samples: bytes, valid: bytes | None = None) -> None:
        x = np.frombuffer(samples, self.source).reshape(self.edge, self.edge)
        self.stored[0][band, ty, tx] = self._encoded(x)
        good = None
        if self.masked:
            good = np.unpackbits(np.frombuffer(valid, np.uint8))[: x.size].reshape(x.shape) > 0 if valid is not None else np.ones(x.shape, bool)
            packed = np.packbits(good, axis=1).tobytes()
            if self.mask.setdefault((ty, tx), packed) != packed:
                raise ValueError("bands of different masks need a NoData value")
        if len(self.sizes) > 1:
            gone = ~good if good is not None else x == self.fill if self.nodata is not None else np.zeros(x.shape, bool)
            self._give(0, band, tx, ty, np.where(gone, np.nan, x))

    def _give(self, level: int, band: int, tx: int, ty: int, x: np.ndarray) -> None:
        """A tile's share of the next level, if there is one; NaN is no sample, and neither is what lies beyond the raster."""
        if level + 1 == len(self.sizes):
            return
        width, height = self.sizes[level]
        x[max(0, height - ty * self.edge) :] = np.nan
        x[:, max(0, width - tx * self.edge) :] = np.nan
        plane = self.planes[level + 1].setdefault((band, ty // 2, tx // 2), np.full((self.edge, self.edge), np.nan))
        half = self.edge // 2
        plane[ty % 2 * half : ty % 2 * half + half, tx % 2 * half : tx % 2 * half + half] = halved(x, self.method)

    def _level(self, level: int) -> list[bytes]:
        """A level's tiles in their order; those that never came are of fill."""
        for (band, ty, tx), x in self.planes[level].items():
            x = np.rint(x) if self.kind.kind != "f" else x
            self.stored[level][band, ty, tx] = self._encoded(np.where(np.isnan(x), self.fill, x))
            self._give(level, band, tx, ty, x)
        self.planes[level] = {}
        empty, (width, height) = None, self.sizes[level]
        out = []
        for band in range(1, self.bands + 1):
            for ty in range(-(-height // self.edge)):
                for tx in range(-(-width // self.edge)):
                    made = self.stored[level].get((band, ty, tx))
                    if made is None:
                        made = empty = empty or self._encoded(np.full((self.edge, self.edge), self.fill))
                    out.append(made)
        return out

    def write(self, out) -> None:
        tiles = [self._level(k) for k in range(len(self.sizes))]
        if self.masked:
            width, height = self.sizes[0]
            empty = bytes(self.edge * -(-self.edge // 8))
            tiles.append([zlib.compress(self.mask.get((ty, tx), empty)) for ty in range(-(-height // self.edge)) for tx in range(-(-width // self.edge))])
        def tags(level: int, word: str, offsets: list[int]) -> list[tuple]:
            if level == len(self.sizes):
                width, height = self.sizes[0]
                return [
                    (254, "I", [4]), (256, "I", [width]), (257, "I", [height]), (258, "H", [1]), (259, "H", [CODECS["deflate"]]), (262, "H", [4]), (277, "H", [1]), (284, "H", [1]),
                    (322, "I", [self.edge]), (323, "I", [self.edge]), (324, word, offsets), (325, "I", [len(x) for x in tiles[level]]), (339, "H", [1]),
                ]
            width, height = self.sizes[level]
            c, a, b, f, d, e = self.grid
            if self.geo and is_point({34735: self.geo[34735]}):
                c, f = c + (a + b) / 2, f + (d + e) / 2
            made = [(254, "I", [1])] if level else []
            made += [
                (256, "I", [width]), (257, "I", [height]), (258, "H", [self.kind.itemsize * 8] * self.bands), (259, "H", [CODECS[self.codec]]), (262, "H", [1]), (277, "H", [self.bands]), (284, "H", [2]),
                (317, "H", [self.predictor]), (322, "I", [self.edge]), (323, "I", [self.edge]), (324, word, offsets), (325, "I", [len(x) for x in tiles[level]]), (339, "H", [{"u": 1, "i": 2, "f": 3}[self.kind.kind]] * self.bands),
            ]
            if self.bands > 1:
                made.append((338, "H", [0] * (self.bands - 1)))
            if not level:
                made.append((34264, "d", [a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1]))
                if self.geo:
                    made += [(t, form, [self.geo[t].encode("latin-1")] if form == "s" else self.geo[t]) for t, form in ((34735, "H"), (34736, "d"), (34737, "s")) if t in self.geo]
                elif self.crs:
                    made.append((34735, "H", geo_keys(self.crs, self.crs_kind)))
            if self.nodata is not None:
                made.append((42113, "s", [self.nodata.encode() + b"\0"]))
            return sorted(made)

        head, _ = layout(tags, [[len(x) for x in level] for level in tiles], {"yes": True, "no": False}.get(self.big))
        out.write(head)
        for level in reversed(tiles):
            for x in level:
                out.write(x)


def layout(tags, counts: list[list[int]], big: bool | None = None) -> tuple[bytes, list[list[int]]]:
    """What a file begins with, header and all directories, and where its tiles go: the last directory's first, in order, those of no bytes nowhere.

    tags(k, word, offsets) gives a directory's tags (number, form of struct, values); word is the form of an offset. big: None takes BigTIFF beyond 4 GB.
    """
    if big is None:
        big = sum(map(sum, counts)) + (1 << 20) + 16 * sum(map(len, counts)) >= 1 << 32
    word, inline = ("Q", 8) if big else ("I", 4)
    codes = {"H": 3, "I": 4, "Q": 16, "d": 12, "s": 2}

    def directory(k: int, at: int, offsets: list[int], last: bool) -> bytes:
        made = sorted(tags(k, word, offsets))
        head, step = (8, 20) if big else (2, 12)
        extra_at, entries, extra = at + head + step * len(made) + inline, b"", b""
        for tag, form, values in made:
            data = values[0] if form == "s" else struct.pack(f"<{len(values)}{form}", *values)
            entries += struct.pack("<HH" + word, tag, codes[form], len(data) if form == "s" else len(values))
            if len(data) > inline:
                entries += struct.pack("<" + word, extra_at + len(extra))
                extra += data + b"\0" * (-len(data) % 8)
            else:
                entries += data.ljust(inline, b"\0")
        size = head + len(entries) + inline + len(extra)
        return struct.pack("<Q" if big else "<H", len(made)) + entries + struct.pack("<" + word, 0 if last else at + size) + extra

    start, n = 16 if big else 8, len(counts)
    sizes = [len(directory(k, 0, [0] * len(counts[k]), False)) for k in range(n)]
    at, offsets = start + sum(sizes), [[] for _ in counts]
    for k in reversed(range(n)):
        for size in counts[k]:
            offsets[k].append(at if size else 0)
            at += size
    out = b"II+\0" + struct.pack("<HHQ", 8, 0, start) if big else b"II*\0" + struct.pack("<I", start)
    return out + b"".join(directory(k, start + sum(sizes[:k]), offsets[k], k == n - 1) for k in range(n)), offsets


class _Counted:
    """A stream's bytes, counted and digested as they are written."""

    def __init__(self, out):
        self.out, self.size, self.digest = out, 0, hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.size += len(data)
        self.digest.update(data)
        self.out.write(data)


class GeoTiffWriter(DataSourceWriter):
    """Options: edge, width, height, bands, dtype, nodata, grid (c,a,b,f,d,e), crs (EPSG:n, crs_kind where it isn't known) or geo (GeoKeys as read), compression, level, predictor,
    overviews (none, nearest or average), bigtiff (auto: beyond 4 GB), samples (stored: in the file's type, else doubles), mask (yes: a mask directory from
    the column valid), state (a folder).

    Rows with columns left and top are of a block there: its tiles count from it, its grid is shifted to it, and
    it ends at the latest at total_width and total_height. Tiles are encoded as they come; what a task holds
    is the block as stored and a quarter of its samples for the overviews. Either all files appear or none.
    With `state`, a file appears as soon as it is whole, and then a row (block, bytes, sha256) in that folder: a job that is stopped keeps what
    it has finished.
    """

    def __init__(self, options):
        self.options, self.job = options, uuid.uuid4().hex

    def write(self, iterator):
        store, path = opened(self.options["path"])
        store.create_dir(f"{path}/_{self.job}", recursive=True)
        names, name, block = [], None, None
        state = self.options.get("state")

        def put():
            made = uuid.uuid4().hex
            with store.open_output_stream(f"{path}/_{self.job}/{made}") as out:
                counted = _Counted(out)
                block.write(counted)
            if state is None:
                names.append((f"{name}.tif", made))
                return
            store.move(f"{path}/_{self.job}/{made}", f"{path}/{name}.tif")
            kept, folder = opened(state)
            kept.create_dir(folder, recursive=True)
            with kept.open_output_stream(f"{folder}/{name}.json") as out:
                out.write(json.dumps({"block": name, "bytes": counted.size, "sha256": counted.digest.hexdigest()}).encode() + b"\n")

        for row in iterator:
            if row.block != name:
                if block is not None:
                    put()
                name, block = row.block, _Block(self.options, *((row.left, row.top) if "left" in row else (0, 0)))
            block.add(row.band, row.tx, row.ty, row.samples, row.valid if block.masked else None)
        if block is not None:
            put()
        return _Files(names)

    def commit(self, messages):
        store, path = opened(self.options["path"])
        made_all = [x for m in messages if m for x in m.names]
        known = {x.base_name for x in store.get_file_info(fs.FileSelector(path))}
        if taken := sorted(known & {name for name, _ in made_all}):
            self.abort(messages)
            raise FileExistsError(f"{taken[0]} is there already")
        for name, made in made_all:
            store.move(f"{path}/_{self.job}/{made}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages):
        store, path = opened(self.options["path"])
        if store.get_file_info(f"{path}/_{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/_{self.job}")


class GeoTiffDataSource(DataSource):
    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        return METADATA if self.options.get("mode") == "metadata" else TILES

    def reader(self, schema):
        return GeoTiffReader(self.options)

    def writer(self, schema, overwrite):
        return GeoTiffWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiffDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def probe(codec: str, predictor: int = 1) -> bool:
    """Whether 8 by 8 samples with negative zero, NaN and infinities come back bit by bit through a codec."""
    x = np.linspace(-1, 1, 64).reshape(8, 8)
    x[0, :4] = (-0.0, np.nan, np.inf, -np.inf)
    back = restored(decoded(encoded(differenced(x, predictor), codec, None), codec, x.nbytes), "<f8", 8, 8, 1, predictor)
    return back.tobytes() == x.tobytes() or np.array_equal(back.astype("<f8").view(np.uint64).ravel(), x.view(np.uint64).ravel())
