"""Shapefiles: round trips, records read by their boxes, files made by hand."""

import struct

import pytest
from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

from gridloom.sources import shapefile

KIND = "parts array<array<struct<x double, y double>>>, fields map<string,string>"


def squares(n):
    ring = lambda x, y, s: [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)]
    return [([ring(3.0 * i, float(i % 5), 2.0), ring(3.0 * i + 0.5, i % 5 + 0.5, 0.25)][: 1 + i % 2], {"name": f"é{i}", "more": None if i % 3 else "x"}) for i in range(n)]


@pytest.mark.parametrize("kind", ["polygon", "line", "point"])
def test_round_trip(spark, tmp_path, kind):
    shapefile.register(spark)
    rows = squares(30) if kind != "point" else [([[(float(i), -i / 7)]], {"name": f"p{i}", "more": None}) for i in range(30)]
    rows += [(None, {"name": "none"}), ([], None)]
    spark.createDataFrame(rows, KIND).repartition(3).write.format("shapefile").mode("append").options(path=str(tmp_path), kind=kind, fields="name,more").save()
    assert len(list(tmp_path.glob("*.shp"))) == 3 == len(list(tmp_path.glob("*.shx"))) == len(list(tmp_path.glob("*.dbf")))
    got = spark.read.format("shapefile").option("records_per_partition", 4).load(str(tmp_path)).collect()
    plain = lambda parts: [[(float(p[0]), float(p[1])) for p in r] for r in parts or []]
    key = lambda x: (str(x[0]), str(x[1]))
    want = sorted(((plain(p), {"name": (f or {}).get("name"), "more": (f or {}).get("more")}) for p, f in rows), key=key)
    assert sorted(((plain(r.parts), r.fields) for r in got), key=key) == want
    for r in got:
        points = [p for ring in plain(r.parts) for p in ring]
        box = (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)) if points else (None,) * 4
        assert (r.xmin, r.ymin, r.xmax, r.ymax) == box and r.kind == (kind if points else None)


def test_boxes_prune_records(spark, tmp_path):
    shapefile.register(spark)
    spark.createDataFrame(squares(200), KIND).coalesce(1).write.format("shapefile").mode("append").options(path=str(tmp_path), fields="name").save()
    read = spark.read.format("shapefile").load(str(tmp_path))
    assert {r.fields["name"] for r in read.where("xmin > 30 and xmax <= 62.0 and ymin = 2").collect()} == {"é12", "é17"}
    assert read.where("record >= 198").count() == 2
    reader, decoded = shapefile.ShapefileReader({"path": str(tmp_path)}), []
    assert list(reader.pushFilters([GreaterThan(("xmin",), 30.0), LessThanOrEqual(("xmax",), 62.0)])) == []
    points = shapefile.ShapefileReader._points
    reader._points = lambda *a: decoded.append(1) or points(*a)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 10 == len(decoded)  # no other record's points were read


def test_files_of_other_writers(spark, tmp_path):
    shapefile.register(spark)
    body = [struct.pack("<i", 0), struct.pack("<i4di4d", 8, 0, 0, 2, 3, 2, 0, 0, 2, 3), struct.pack("<i3d", 11, 5, 6, 7)]
    at, shp, shx = 50, b"", b""
    for i, b in enumerate(body):
        shx += struct.pack(">2i", at, len(b) // 2)
        shp += struct.pack(">2i", i + 1, len(b) // 2) + b
        at += 4 + len(b) // 2
    (tmp_path / "A.SHP").write_bytes(bytes(100) + shp)
    (tmp_path / "A.SHX").write_bytes(bytes(100) + shx)
    got = [(r.record, r.kind, r.xmin, r.ymax, [[tuple(p) for p in x] for x in r.parts], r.fields) for r in spark.read.format("shapefile").load(str(tmp_path)).orderBy("record").collect()]
    assert got == [(0, None, None, None, [], {}), (1, "points", 0.0, 3.0, [[(0.0, 0.0)], [(2.0, 3.0)]], {}), (2, "point", 5.0, 6.0, [[(5.0, 6.0)]], {})]


def test_long_texts_are_refused_and_nothing_appears(spark, tmp_path):
    shapefile.register(spark)
    rows = [([[(0.0, 0.0)]], {"name": "x" * 9})]
    with pytest.raises(Exception, match="longer than"):
        spark.createDataFrame(rows, KIND).write.format("shapefile").mode("append").options(path=str(tmp_path / "o"), kind="point", fields="name", width=8).save()
    assert not list(tmp_path.glob("o/*.shp"))
    spark.createDataFrame([], KIND).write.format("shapefile").mode("append").options(path=str(tmp_path / "none")).save()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("shapefile").load(str(tmp_path / "empty")).count() == 0
