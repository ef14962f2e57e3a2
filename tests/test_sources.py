"""Files written and read back, and formats made by hand."""

import gzip
import json
import sqlite3
import tracemalloc
import struct
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.operators import tiles
from gridloom.sources import dted, files, geotiff, sqlite, telemetry, vector, vrt
from gridloom.streaming import requests as streams


@pytest.mark.parametrize(("codec", "predictor", "dtype"), [("none", 1, "float32"), ("deflate", 2, "int16"), ("zstd", 3, "float64"), ("lzma", 1, "uint16"), ("packbits", 1, "uint8"), ("deflate", 3, "float32"), ("lzw", 1, "uint8"), ("lzw", 2, "int16"), ("lzw", 3, "float64")])
def test_geotiff_keeps_every_sample(spark, tmp_path, codec, predictor, dtype):
    geotiff.register(spark)
    rng = np.random.default_rng(2)
    a = rng.integers(0, 200, (2, 50, 70)).astype(dtype)
    if np.dtype(dtype).kind == "f":
        a[0, 0, :3] = [-0.0, np.inf, 1e-30]
    rows = [(0, 0, b + 1, x, y, float(a[b, y, x]), True) for b in range(2) for y in range(50) for x in range(70)]
    cells = spark.createDataFrame(rows, "src long, ord long, band int, x long, y long, v double, valid boolean")
    packed = tiles.pack(cells, 16).select(F.lit("b").alias("block"), "band", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), "samples")
    out = packed.repartition("block").sortWithinPartitions("block").write.format("geotiff").mode("append")
    out.options(path=str(tmp_path), edge=16, width=70, height=50, bands=2, dtype=dtype, compression=codec, predictor=predictor, grid="100,2,0,200,0,-2").save()
    got = np.zeros((2, 50, 70))
    for r in spark.read.format("geotiff").load(str(tmp_path)).collect():
        got[r.band - 1, r.y : r.y + r.h, r.x : r.x + r.w] = np.frombuffer(r.samples).reshape(r.h, r.w)
    assert got.astype(dtype).tobytes() == a.tobytes()
    m = spark.read.format("geotiff").option("mode", "metadata").load(str(tmp_path)).first()
    assert (m.width, m.height, m.bands, m.dtype, m.compression, m.c, m.a, m.e, m.tiles) == (70, 50, 2, dtype, codec, 100.0, 2.0, -2.0, 40)
    assert spark.read.format("geotiff").option("window", "0,0,16,16").load(str(tmp_path)).count() == 2
    with pytest.raises(Exception, match="is there already"):
        out.save()


def test_geotiff_lzw_and_strips(spark, tmp_path):
    geotiff.register(spark)
    data = bytes([7, 7, 7, 8, 8, 9])
    codes = [256, 7, 258, 8, 8, 9, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    tags = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, 8), (259, 3, 1, 5), (262, 3, 1, 1), (273, 4, 1, 8 + 2 + 12 * 9 + 4), (277, 3, 1, 1), (278, 3, 1, 2), (279, 4, 1, len(raw))]
    body = b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0) + raw
    (tmp_path / "a.tif").write_bytes(body)
    r = spark.read.format("geotiff").load(str(tmp_path)).first()
    assert np.frombuffer(r.samples).astype(np.uint8).tobytes() == data


@pytest.mark.parametrize("size", [0, 1, 2, 300, 5000, 70_000])
@pytest.mark.parametrize("letters", [1, 3, 256])
def test_lzw_round_trips(size, letters):
    data = np.random.default_rng(size).integers(0, letters, size).astype(np.uint8).tobytes()
    packed = geotiff.encoded(data, "lzw", None)
    assert geotiff.decoded(packed, "lzw", size) == data
    # read once more, a bit after another, with widths that grow one code early
    bits = "".join(f"{b:08b}" for b in packed)
    out, table, last, at, width = [], [], b"", 0, 9
    while True:
        code, at = int(bits[at : at + width], 2), at + width
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        table += [last + word[:1]] if last else []
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    assert b"".join(out) == data


def dted_cell(west, south, rows, columns, value):
    def corner(v, ways):
        return f"{abs(v):03d}0000{ways[v < 0]}"

    head = f"UHL1{corner(west, 'EW')}{corner(south, 'NS')}00300030NA  U  {'':12}{columns:04d}{rows:04d}0".ljust(80)
    out = head.encode() + b" " * (648 + 2700)
    for c in range(columns):
        v = [value(rows - 1 - k, c) for k in range(rows)]
        words = np.array([(0x8000 | -x) if x < 0 else x for x in v], ">u2").tobytes()
        out += struct.pack(">BBHHH", 0xAA, 0, c, c, 0) + words + b"\0\0\0\0"
    return out


def test_dted_cells(spark, tmp_path):
    dted.register(spark)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "tile.dt1").write_bytes(dted_cell(-7, 50, 9, 5, lambda y, x: -32767 if (x, y) == (2, 3) else y - x))
    (tmp_path / "other.dt0").write_bytes(b"not read")
    read = spark.read.format("dted").option("level", "1")
    m = read.option("mode", "metadata").load(str(tmp_path)).first()
    assert (m.west, m.south, m.level, m.rows, m.columns, m.factor) == (-7, 50, 1, 9, 5, 2)
    got = {(r.x, r.y): (r.v, r.valid) for r in spark.read.format("dted").option("level", "1").load(str(tmp_path)).collect()}
    assert len(got) == 45 and all(got[x, y] == (float(y - x), True) for x in range(5) for y in range(9) if (x, y) != (2, 3))
    assert not got[2, 3][1]


def test_dted_sink_refuses_odd_cells(spark, tmp_path):
    dted.register(spark)
    kind = "path string, west int, south int, x int, posts array<int>"
    for rows, said in (([("a.dt0", 1, 2, 0, [1, 2, 3]), ("a.dt0", 1, 2, 2, [1, 2, 3])], "every column"), ([("a.dt0", 1, 2, 0, [1, 2, 3]), ("a.dt0", 1, 2, 1, [1, 2])], "different lengths"), ([("a.dt0", 1, 2, 0, [40000])], "beyond")):
        with pytest.raises(Exception, match=said):
            spark.createDataFrame(rows, kind).coalesce(1).write.format("dted").mode("append").save(str(tmp_path / "o"))
    assert not list(tmp_path.glob("o/*"))
    spark.createDataFrame([("d/a.dt0", -7, -3, x, [x, -5, dted.NODATA]) for x in (0, 1, 2)], kind).coalesce(1).write.format("dted").mode("append").save(str(tmp_path / "p"))
    got = {(r.x, r.y): (r.v, r.valid) for r in spark.read.format("dted").load(str(tmp_path / "p")).collect()}
    assert got == {(x, y): (v, y < 2) for x in (0, 1, 2) for y, v in enumerate((float(x), -5.0, -32767.0))}


VRT = """<VRTDataset rasterXSize="40" rasterYSize="20"><SRS>EPSG:4326</SRS><GeoTransform>1,0.5,0,2,0,-0.5</GeoTransform><VRTRasterBand dataType="Int16" band="1"><NoDataValue>-1</NoDataValue>
<ComplexSource><SourceFilename relativeToVRT="1">Aa.tif</SourceFilename><SourceBand>1</SourceBand><SrcRect xOff="0" yOff="0" xSize="20" ySize="20"/><DstRect xOff="0" yOff="0" xSize="20" ySize="20"/><NODATA>-1</NODATA></ComplexSource>
<SimpleSource><SourceFilename relativeToVRT="0">/data/b.tif</SourceFilename><SourceBand>1</SourceBand><SrcRect xOff="0" yOff="0" xSize="20" ySize="20"/><DstRect xOff="20" yOff="0" xSize="20" ySize="20"/></SimpleSource></VRTRasterBand></VRTDataset>"""


def test_vrt_sources_in_order(spark, tmp_path):
    (tmp_path / "m.vrt").write_text(VRT)
    rows = vrt.read(spark, str(tmp_path / "m.vrt")).orderBy("ordinal").collect()
    assert [(r.kind, r.filename, r.relative, r.dst.x, r.nodata) for r in rows] == [("ComplexSource", "Aa.tif", True, 0.0, "-1"), ("SimpleSource", "/data/b.tif", False, 20.0, None)]
    assert rows[0].path.endswith("/Aa.tif") and rows[0].width == 40
    assert vrt.read(spark, str(tmp_path / "m.vrt"), "aA").count() == 1
    (tmp_path / "Aa.tif").write_bytes(b"1")
    there = files.listing(spark, str(tmp_path), (".tif",))
    assert [r.filename for r in vrt.missing(vrt.read(spark, str(tmp_path / "m.vrt")), there).collect()] == ["/data/b.tif"]
    for bad in (VRT.replace("<VRTDataset", "<!DOCTYPE x><VRTDataset", 1), VRT.replace('ySize="20"/><NODATA>', 'ySize="10"/><NODATA>'), VRT.replace("<NODATA>-1</NODATA>", "<LUT>0:1</LUT>")):
        (tmp_path / "bad.vrt").write_text(bad)
        with pytest.raises(Exception, match="bad.vrt"):
            vrt.read(spark, str(tmp_path / "bad.vrt")).collect()


def test_vrt_in_pieces(spark, tmp_path, monkeypatch):
    """Pieces end inside names, characters and forbidden markers."""
    (tmp_path / "m.vrt").write_text(VRT.replace("Aa.tif", "Aäé日.tif"))
    (tmp_path / "n.vrt").write_text(VRT)
    want = sorted(map(str, vrt.read(spark, str(tmp_path)).collect()))
    assert len(want) == 4 and sum("Aäé日.tif" in r for r in want) == 1
    monkeypatch.setattr(vrt, "PIECE_BYTES", 7)
    assert sorted(map(str, vrt.read(spark, str(tmp_path)).collect())) == want
    for bad in (VRT.replace("<VRTDataset", "<!DOCTYPE x><VRTDataset", 1), VRT.replace("<VRTDataset", "<!doctype x [<!entity a 'b'>]><VRTDataset", 1), VRT.replace("VRTRasterBand", "Other")):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad/bad.vrt").write_text(bad)
        with pytest.raises(Exception, match="bad.vrt"):
            vrt.read(spark, str(tmp_path / "bad")).collect()


def test_a_large_vrt_is_no_tree_in_memory():
    """As a tree and objects, 20,000 sources and their masks took 68 MB; a task keeps columns, and the objects of a chunk."""
    source = '<ComplexSource><SourceFilename relativeToVRT="1">a/%d.tif</SourceFilename><SourceBand>1</SourceBand><SrcRect xOff="0" yOff="0" xSize="9" ySize="9"/><DstRect xOff="%d" yOff="0" xSize="9" ySize="9"/></ComplexSource>'
    body = "".join(source % (i, i) for i in range(20_000))
    text = f'<VRTDataset rasterXSize="9" rasterYSize="9"><VRTRasterBand dataType="Byte" band="1">{body}</VRTRasterBand><MaskBand><VRTRasterBand>{body}</VRTRasterBand></MaskBand></VRTDataset>'.encode()
    batches = [pa.RecordBatch.from_pydict({"vrt": ["x"], "k": pa.array([i], pa.int32()), "piece": [text[j : j + 65536]]}) for i, j in enumerate(range(0, len(text), 65536))]
    held = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        rows = [(len(b), b.column("ordinal")[0].as_py(), pa.total_allocated_bytes() - held) for b in vrt._parsed(iter(batches))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(n for n, *_ in rows) == 20_000 and [k for _, k, _ in rows[:3]] == [0, vrt.CHUNK, 2 * vrt.CHUNK]
    assert peak < 15e6 and max(b for *_, b in rows) < 15e6


def test_block_vrt_reads_back(spark, tmp_path):
    blocks = spark.createDataFrame([("b", 10, 0, 20, 20, [1.0, 0.5, 0.0, 2.0, 0.0, -0.5])], "block string, x long, y long, w long, h long, grid array<double>")
    part = "block string, ordinal int, kind string, path string, src struct<x:long,y:long>, dst struct<x:long,y:long>, skip_nodata boolean, use_mask boolean, x long, y long, w long, h long"
    parts = spark.createDataFrame([("b", 1, "SimpleSource", "/d/b&c.tif", (0, 0), (20, 0), False, False, 20, 0, 10, 20), ("b", 0, "ComplexSource", "/d/a.tif", (0, 0), (0, 0), True, True, 10, 0, 10, 20)], part)
    (tmp_path / "o.vrt").write_text(vrt.block_vrts(blocks, parts, "Int16", "-1", "EPSG:4326").first().vrt)
    rows = vrt.read(spark, str(tmp_path / "o.vrt")).orderBy("ordinal").collect()
    assert [(r.filename, r.src.x, r.dst.x, r.dst.w, r.use_mask) for r in rows] == [("/d/a.tif", 10.0, 0.0, 10.0, True), ("/d/b&c.tif", 0.0, 10.0, 10.0, False)]


def message(*fields):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return b"".join(varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3) + varint(v) for k, v in fields)


def test_vector_tiles_in_sqlite(spark, tmp_path):
    tile = message((3, message((15, 2), (1, b"building"), (2, b""), (2, b"\x08\x01"))), (3, message((1, b"water"), (2, b""))))
    path = str(tmp_path / "t.mbtiles")
    with sqlite3.connect(path) as db:
        db.execute("create table tiles (zoom_level integer, tile_column integer, tile_row integer, tile_data blob)")
        db.executemany("insert into tiles values (?, ?, ?, ?)", [(5, 1, 2, tile), (6, 1, 2, gzip.compress(tile)), (6, 2, 2, b"")])
    found = sqlite.read(spark, path, "tiles")
    assert {(r.zoom_level, r.tiles) for r in sqlite.zoom_payload(found).collect()} == {(5, 1), (6, 2)}
    rows = vector.features(found, ["zoom_level", "tile_column"])
    assert sorted((r.zoom_level, r.layer, r.features) for r in rows.collect()) == [(5, "building", 2), (5, "water", 1), (6, "building", 2), (6, "water", 1)]
    with pytest.raises(ValueError):
        vector.tile_layers(b"\x1a\xff")


def test_styles(spark):
    style = {"layers": [
        {"id": "bg", "type": "background", "paint": {"background-color": "#fff"}}, {"id": "w", "type": "fill", "source-layer": "water", "paint": {"fill-color": "#00f"}},
        {"id": "r", "type": "line", "source-layer": "road", "filter": ["all", ["==", "class", "x"], [">", "rank", 3]], "layout": {"text-field": "{name:de} {ref}"}, "maxzoom": 5},
    ]}
    df = spark.createDataFrame([(json.dumps(style),)], "style string")
    need = {r.layer: r.fields for r in df.select(F.explode(vector.required_fields("style")).alias("s")).select("s.*").collect()}
    assert need == {"road": {"class": "String", "rank": "Number", "name:de": "String", "ref": "String"}, "water": {}}
    schema = spark.createDataFrame([("road", {"class": "Keep"})], "layer string, fields map<string,string>")
    done = {r.layer: (r.fields, list(r.added)) for r in vector.completed_schema(df.select(F.explode(vector.required_fields("style")).alias("s")).select("s.*"), schema).collect()}
    assert done["road"][0]["class"] == "Keep" and done["road"][1] == ["name:de", "rank", "ref"]
    made = json.loads(df.select(vector.with_world_below("style").alias("s")).first().s)
    assert [x["id"] for x in made["layers"]][-1] == "w" and made["layers"][-1]["minzoom"] == 6 and len(made["layers"]) == 1 + 9 + 1
    sld = spark.createDataFrame([("<a><MaxScaleDenominator>100.0</MaxScaleDenominator></a>",)], "s string").select(vector.widened_scales("s").alias("s")).first().s
    assert float(sld.split(">")[2].split("<")[0]) == pytest.approx(100.000001, abs=1e-9)
    geo = spark.createDataFrame([('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"p"},"geometry":{"type":"Point","coordinates":[1,2]}}]}',)], "value string")
    assert tuple(vector.geojson_features(geo).first()) == (0, "Point", "p", "[1,2]")


def test_metadata_gets_the_fields_that_layers_lack(spark):
    metadata = spark.createDataFrame([("format", "pbf"), ("json", '{"vector_layers":[{"id":"b","fields":{"z":"Number"}},{"id":"a","fields":{}}]}')], "name string, value string")
    required = spark.createDataFrame([("b", {"z": "String", "k": "String"}), ("c", {"q": "Number"})], "layer string, fields map<string,string>")
    got = {r.name: r.value for r in vector.normalized_metadata(metadata, required).collect()}
    assert got["format"] == "pbf" and len(got) == 2
    assert json.loads(got["json"]) == {"vector_layers": [{"id": "a", "fields": {}}, {"id": "b", "fields": {"k": "String", "z": "Number"}}, {"id": "c", "fields": {"q": "Number"}}]}


def test_icons_without_a_label(spark):
    symbol = "<TextSymbolizer uom='m'><Geometry/><Label><ogc:Function><ogc:PropertyName>{0}</ogc:PropertyName></ogc:Function></Label>{1}<Priority><ogc:Add><ogc:Literal>3</ogc:Literal></ogc:Add></Priority></TextSymbolizer>"
    rule = "<Rule><Name>r &amp; s</Name><ogc:Filter><ogc:Not/></ogc:Filter><MaxScaleDenominator>9</MaxScaleDenominator>{0}</Rule>"
    sld = "<StyledLayerDescriptor xmlns='http://www.opengis.net/sld' xmlns:ogc='http://www.opengis.net/ogc'><NamedLayer><Name>w:{0}</Name><FeatureTypeStyle>{1}</FeatureTypeStyle></NamedLayer></StyledLayerDescriptor>"
    drawn, plain, other = symbol.format("name:en", "<Graphic/>"), symbol.format("name:en", ""), symbol.format("ref", "<Graphic/>")
    rows = [(0, None), (1, sld.format("poi", rule.format(plain) + rule.format(other))), (2, sld.format("poi", rule.format(drawn + plain) + rule.format(other))), (3, sld.format("road", rule.format(drawn)))]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, t string").select("i", vector.with_unlabelled_icons("t").alias("s")).collect()}
    assert got[0] is None and got[1] == rows[1][1]
    spaces = {"s": "http://www.opengis.net/sld", "o": "http://www.opengis.net/ogc"}
    for i, padded in ((2, 1), (3, 0)):
        assert "<sld:Label><![CDATA[ ]]></sld:Label>" in got[i]
        root = ElementTree.fromstring(got[i])
        rules = root.findall(".//s:Rule", spaces)
        made = rules[-1]
        assert [x.tag.split("}")[1] for x in made] == ["Name", "Filter", "MaxScaleDenominator", "TextSymbolizer"]
        assert made.findtext("s:Name", None, spaces) == "r & s-unlabelled-icon"
        assert [x.tag.split("}")[1] for x in made.find("o:Filter/o:And", spaces)] == ["Not", "Or"]
        assert [x.text for x in made.findall(".//o:PropertyName", spaces)] == ["name:en", "name:en"]
        icon = made.find("s:TextSymbolizer", spaces)
        assert icon.attrib == {"uom": "m"} and icon.find("s:Geometry", spaces) is not None and icon.find("s:Graphic", spaces) is not None
        assert [x.tag.split("}")[1] for x in icon.find("s:Priority/o:Sub", spaces)] == ["Add", "Literal"]
        assert {x.get("name"): x.text for x in icon.findall("s:VendorOption", spaces)} == vector.ICON_OPTIONS
        assert len(root.findall(".//s:Rule/s:TextSymbolizer/s:VendorOption", spaces)) == len(vector.ICON_OPTIONS) + 2 * padded


def test_telemetry_text(spark):
    text = "SECTION:cpu.stat\nusage_usec 77\nSECTION:memory.current\n4096\nSECTION:process\nVmRSS:   12 kB\nSECTION:jstat\n S0U EU OU\n 1.0 2.5 3.0\nSECTION:cache\n99 /gwc\nSECTION:vm\nMemAvailable: 5 kB\n"
    r = telemetry.samples(spark.createDataFrame([("a", text)], "at string, value string")).first()
    assert (r.cpu["usage_usec"], r.memory_bytes, r.rss_bytes, r.available_bytes, r.cache_bytes, r.heap_bytes) == (77, 4096, 12288, 5120, 99, 6.5 * 1024)


def test_audit_log(spark, tmp_path):
    line = {"time": "t", "api": {"name": "GetObject", "object": "o", "statusCode": 206}, "requestHeader": {"User-Agent": "aws-sdk-java/2", "Range": "bytes=0-1", "Authorization": "x"}, "responseHeader": {"Content-Length": "2"}}
    (tmp_path / "a.json").write_text(json.dumps(line) + "\n")
    r = telemetry.audit_events(spark, str(tmp_path)).first()
    assert (r.api, r.object, r.status, r.user_agent, r.range, r.content_length) == ("GetObject", "o", 206, "aws-sdk-java/2", "bytes=0-1", 2)


def test_listings(spark, tmp_path):
    for name in ("b/X1.tif", "b/x2.TIF", "a/x3.tif", "a/note.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1" * len(name))
    assert [r.name for r in files.listing(spark, str(tmp_path), (".tif",), recursive=True).orderBy("ord").collect()] == ["x3.tif", "X1.tif", "x2.TIF"]
    assert files.listing(spark, str(tmp_path), (".tif",), "X1", True).count() == 1
    found = files.folders(spark, [str(tmp_path / "b"), str(tmp_path)], (".tif",)).orderBy("ord").collect()
    assert [(r.name, r.folder) for r in found] == [("X1.tif", 0), ("x2.TIF", 0), ("x3.tif", 1)]
    assert files.digests(spark, str(tmp_path)).count() == 4


def test_streams_equal_tables(spark, tmp_path):
    rows = [(f"2026-01-01 00:{m:02d}:00", "GetMap", m % 3 != 0, float(m), m % 4, "f", "d", m % 20) for m in range(60)]
    t = spark.createDataFrame(rows, "at string, operation string, ok boolean, seconds double, user int, file string, digest string, ordinal int").withColumn("at", F.to_timestamp("at"))
    t.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    got = streams.drained(streams.windowed(source(), "10 minutes"), str(tmp_path / "w"), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streams.windowed(t, "10 minutes").collect()))
    assert streams.drained(streams.once(source()), str(tmp_path / "o")).count() == streams.once(t).count() == 20
    tiles_ = t.select(F.lit(3).alias("z"), F.col("ordinal").cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    tiles_.write.parquet(str(tmp_path / "t"))
    stream = streams.cache_hits(spark.readStream.schema(tiles_.schema).parquet(str(tmp_path / "t")))
    made = streams.drained(stream, str(tmp_path / "c"), "update")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, streams.cache_hits(tiles_).collect()))
    assert streams.sessions(t, "2 minutes").count() > 0
