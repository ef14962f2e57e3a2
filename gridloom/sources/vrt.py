"""VRT mosaics: their sources as rows, and the text of a block's VRT from rows."""

from __future__ import annotations

import codecs
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.text import relative_path

SOURCE = pa.schema([
    ("ordinal", pa.int32()), ("kind", pa.string()), ("filename", pa.string()), ("relative", pa.bool_()), *[(k, pa.struct([(c, pa.float64()) for c in "xywh"])) for k in ("src", "dst")], ("nodata", pa.string()), ("use_mask", pa.bool_()),
])
HEAD = {"vrt": pa.string(), "width": pa.int64(), "height": pa.int64(), "srs": pa.string(), "grid": pa.list_(pa.float64()), "dtype": pa.string(), "vrt_nodata": pa.string()}
_RECT = "struct<x:double,y:double,w:double,h:double>"
ROWS = f"vrt string, width long, height long, srs string, grid array<double>, dtype string, vrt_nodata string, ordinal int, kind string, filename string, relative boolean, src {_RECT}, dst {_RECT}, nodata string, use_mask boolean"
#: Bytes of a text that a task gets at once, and sources that it holds as Python objects.
PIECE_BYTES, CHUNK = 4 << 20, 2000
#: What a source may hold; anything else transforms samples and isn't supported.
ALLOWED = {"SourceFilename", "SourceBand", "SourceProperties", "SrcRect", "DstRect", "NODATA", "UseMaskBand"}


def _rect(node: ET.Element | None):
    return None if node is None else {k: float(node.get(a)) for k, a in zip("xywh", ("xOff", "yOff", "xSize", "ySize"), strict=True)}


class _Mosaic:
    """A VRT that comes in pieces: elements go as soon as they are read, sources are kept as Arrow columns until the text ends."""

    def __init__(self, name: str):
        self.name, self.tail, self.error, self.n = name, "", None, 0
        self.parser, self.decoder = ET.XMLPullParser(("start", "end")), codecs.getincrementaldecoder("utf-8")("replace")
        self.path, self.root, self.first, self.rows, self.made = [], None, None, [], []

    def refuse(self, why: str) -> None:
        raise ValueError(f"{self.name}: {why}")

    def feed(self, piece: bytes, last: bool = False) -> None:
        text = self.decoder.decode(piece, last)
        seen = (self.tail + text).upper()
        if "<!DOCTYPE" in seen or "<!ENTITY" in seen:
            self.refuse("document types and entities aren't supported")
        self.tail = (self.tail + text)[-8:]
        self.parser.feed(text)
        if last:
            self.parser.close()
        for event, node in self.parser.read_events():
            if event == "start":
                self.started(node)
            else:
                self.ended(node)

    def started(self, node: ET.Element) -> None:
        if not self.path:
            self.root = node
        elif len(self.path) == 1 and node.tag == "VRTRasterBand" and self.first is None:
            self.first = node
        self.path.append(node)

    def ended(self, node: ET.Element) -> None:
        self.path.pop()
        if len(self.path) < 2:
            return
        if self.path[1] is not self.first:
            self.path[-1].remove(node)
        elif len(self.path) == 2 and node.tag in ("SimpleSource", "ComplexSource"):
            self.source(node)
            self.first.remove(node)

    def source(self, node: ET.Element) -> None:
        odd = sorted({c.tag for c in node} - ALLOWED)
        src, dst = _rect(node.find("SrcRect")), _rect(node.find("DstRect"))
        if odd or node.get("resampling") or src is None or dst is None or (src["w"], src["h"]) != (dst["w"], dst["h"]):
            self.error = self.error or f"source {self.n} is transformed: {', '.join(odd) or 'resampled'}"
            return
        name = node.find("SourceFilename")
        self.rows.append({
            "ordinal": self.n, "kind": node.tag, "filename": name.text, "relative": name.get("relativeToVRT", "0") == "1", "src": src, "dst": dst, "nodata": node.findtext("NODATA"),
            "use_mask": node.findtext("UseMaskBand", "false").lower() in ("true", "1"),
        })
        self.n += 1
        if len(self.rows) == CHUNK:
            self.pack()

    def pack(self) -> None:
        self.made.append(pa.RecordBatch.from_pylist(self.rows, SOURCE))
        self.rows = []

    def sources(self) -> Iterator[pa.RecordBatch]:
        self.feed(b"", True)
        root, band = self.root, self.first
        if root.tag != "VRTDataset" or root.get("subClass") or band is None or band.get("subClass"):
            self.refuse("not a plain mosaic")
        if self.error:
            self.refuse(self.error)
        if self.rows:
            self.pack()
        grid = [float(v) for v in root.findtext("GeoTransform", "0,1,0,0,0,1").split(",")]
        head = self.name, int(root.get("rasterXSize")), int(root.get("rasterYSize")), root.findtext("SRS"), grid, band.get("dataType"), band.findtext("NoDataValue")
        for rows in self.made:
            columns = [pa.array([v] * len(rows), k) for v, k in zip(head, HEAD.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *rows.columns], [*HEAD, *SOURCE.names])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sources of VRTs whose pieces follow one another."""
    at = None
    for batch in batches:
        for name, k, piece in zip(*(batch.column(c) for c in ("vrt", "k", "piece")), strict=True):
            if k.as_py() == 0:
                if at is not None:
                    yield from at.sources()
                at = _Mosaic(name.as_py())
            at.feed(memoryview(piece.as_buffer()))
    if at is not None:
        yield from at.sources()


def read(spark: SparkSession, path: str, contains: str | None = None) -> DataFrame:
    """A row per source of each VRT at path, in order; an unsupported VRT raises. contains: part of the source's base name.

    Tasks get a text in pieces of PIECE_BYTES and hold its sources as columns, not its tree.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("vrt"), F.col("value").cast("binary").alias("value"))
    last = F.floor(F.greatest(F.octet_length("value") - 1, F.lit(0)) / PIECE_BYTES).cast("int")
    pieces = text.select("vrt", "value", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    # Spark bounds a batch's bytes (spark.sql.execution.arrow.maxBytesPerBatch)
    rows = pieces.select("vrt", "k", F.substring("value", F.col("k") * PIECE_BYTES + 1, F.lit(PIECE_BYTES)).alias("piece")).mapInArrow(_parsed, ROWS)
    if contains:
        rows = rows.where(F.contains(F.lower(F.element_at(F.split(F.regexp_replace("filename", r"\\", "/"), "/"), -1)), F.lit(contains.lower())))
    folder = F.regexp_replace("vrt", r"[^/]*$", "")
    return rows.withColumn("path", F.when(F.col("relative"), F.concat(folder, "filename")).otherwise(F.col("filename")))


def missing(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Sources whose file a listing (path) lacks."""
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return sources.join(files.select(bare("path").alias("__path")), bare("path") == F.col("__path"), "left_anti")


def _element(tag: str, r: Column, dx, dy, w: Column, h: Column) -> Column:
    n = lambda v: v.cast("long").cast("string")
    return F.concat(F.lit(f'<{tag} xOff="'), n(r["x"] + dx), F.lit('" yOff="'), n(r["y"] + dy), F.lit('" xSize="'), n(w), F.lit('" ySize="'), n(h), F.lit('"/>'))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def block_vrts(blocks: DataFrame, parts: DataFrame, dtype: str, nodata: str, srs: str, folder: str | None = None) -> DataFrame:
    """(block, vrt): the text of each block's VRT, its sources in order and clipped to it, with a mask band of those that have masks.

    blocks: block, x, y, w, h, grid (array of six). parts: block, ordinal, kind, path, src and dst (structs in
    source and mosaic pixels), skip_nodata, use_mask and x, y, w, h, what the block takes of dst. folder: where the texts will
    lie; paths in the same store are then written as seen from there.
    """
    joined = parts.join(blocks.select("block", F.col("x").alias("bx"), F.col("y").alias("by")), "block")
    here = F.struct("x", "y")
    # a column of its own, so that it is made once and named often
    joined = joined.withColumn("_seen", F.col("path") if folder is None else relative_path(F.col("path"), F.lit(folder)))
    path = F.col("_seen")
    relative = F.when(path != F.col("path"), "1").otherwise("0")
    file = F.concat(F.lit('<SourceFilename relativeToVRT="'), relative, F.lit('">'), escaped(path), F.lit("</SourceFilename><SourceBand>"))
    place = F.concat(_element("SrcRect", F.col("src"), F.col("x") - F.col("dst.x"), F.col("y") - F.col("dst.y"), F.col("w"), F.col("h")), _element("DstRect", here, -F.col("bx"), -F.col("by"), F.col("w"), F.col("h")))
    mask = F.when(F.col("use_mask"), F.concat(F.lit("<ComplexSource>"), file, F.lit("mask,1</SourceBand>"), place, F.lit("</ComplexSource>")))
    source = F.concat(
        F.lit("<"), "kind", F.lit(">"), file, F.lit("1</SourceBand>"), place,
        F.when(F.col("skip_nodata"), F.lit(f"<NODATA>{nodata}</NODATA>")).otherwise(""), F.when(F.col("use_mask"), F.lit("<UseMaskBand>true</UseMaskBand>")).otherwise(""), F.lit("</"), "kind", F.lit(">"),
    )
    made = joined.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("ordinal", source.alias("text"), mask.alias("mask")))).alias("s"))
    body = made.select("block", F.array_join(F.transform("s", lambda s: s["text"]), "").alias("body"), F.array_join(F.array_compact(F.transform("s", lambda s: s["mask"])), "").alias("masks"))
    masks = F.when(F.col("masks") != "", F.concat(F.lit('<MaskBand><VRTRasterBand dataType="Byte">'), "masks", F.lit("</VRTRasterBand></MaskBand>"))).otherwise("")
    head = F.concat(
        F.lit('<VRTDataset rasterXSize="'), F.col("w").cast("string"), F.lit('" rasterYSize="'), F.col("h").cast("string"), F.lit('"><SRS>'), escaped(F.lit(srs)), F.lit("</SRS><GeoTransform>"),
        F.array_join(F.transform("grid", lambda v: v.cast("string")), ","), F.lit(f'</GeoTransform><VRTRasterBand dataType="{dtype}" band="1"><NoDataValue>{nodata}</NoDataValue>'),
    )
    return blocks.join(body, "block", "left").select("block", F.concat(head, F.coalesce("body", F.lit("")), F.lit("</VRTRasterBand>"), F.coalesce(masks, F.lit("")), F.lit("</VRTDataset>")).alias("vrt"))


def stage_vrt(blocks: DataFrame, width: int, height: int, dtype: str, nodata: str, srs: str, grid: tuple[float, ...]) -> DataFrame:
    """(block, vrt): one VRT over all finished blocks (ordinal, path, x, y, w, h), no row unless there are several.

    The blocks of a stage are disjoint and a line of text each; they meet in the one text that is the result.
    """
    several = blocks.agg(F.count("*").alias("n")).where("n > 1")
    whole = several.select(F.lit("stage").alias("block"), *[F.lit(v).cast("long").alias(k) for k, v in zip("xywh", (0, 0, width, height), strict=True)], F.array(*[F.lit(float(v)) for v in grid]).alias("grid"))
    rect = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("w").alias("w"), F.col("h").alias("h"))
    parts = blocks.select(
        F.lit("stage").alias("block"), "ordinal", F.lit("SimpleSource").alias("kind"), "path", rect.alias("src"), F.struct("x", "y", "w", "h").alias("dst"), F.lit(False).alias("skip_nodata"), F.lit(False).alias("use_mask"), "x", "y", "w", "h"
    )
    return block_vrts(whole, parts, dtype, nodata, srs)
