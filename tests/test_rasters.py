"""Masks, types, coordinate systems and NoData values of rasters: kept as they are, or refused; jobs that go on where they stopped."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import windows
from gridloom.plans import jobs, views
from gridloom.sources import geotiff

WIDE = "block string, band int, tx int, ty int, samples binary, valid binary"


def put(spark, path, name, bands, x=0, y=0, valid=None, edge=16, **options):
    """Writes bands (arrays of one type) as stored tiles, with a mask directory where `valid` is given."""
    geotiff.register(spark)
    h, w = bands[0].shape
    rows = []
    for b, a in enumerate(bands):
        for ty in range(-(-h // edge)):
            for tx in range(-(-w // edge)):
                tile, good = np.zeros((edge, edge), a.dtype), np.zeros((edge, edge), bool)
                part = a[ty * edge : ty * edge + edge, tx * edge : tx * edge + edge]
                tile[: part.shape[0], : part.shape[1]] = part
                if valid is not None:
                    v = (valid if valid.ndim == 2 else valid[b])[ty * edge : ty * edge + edge, tx * edge : tx * edge + edge]
                    good[: v.shape[0], : v.shape[1]] = v
                rows.append((name, b + 1, tx, ty, tile.tobytes(), np.packbits(good).tobytes()))
    made = {"path": str(path), "edge": edge, "width": w, "height": h, "bands": len(bands), "dtype": bands[0].dtype.name, "samples": "stored", "grid": f"{100 + 2 * x},2,0,{200 - 2 * y},0,-2"}
    made |= {"mask": "yes"} if valid is not None else {}
    spark.createDataFrame(rows, WIDE).repartition(1).sortWithinPartitions("block").write.format("geotiff").mode("append").options(**made, **options).save()


def whole(spark, path, dtype, origin=(100, 200), size=(40, 60), bands=1):
    """The samples and validity of all files of a folder on one grid."""
    out, good = np.zeros((bands, *size), dtype), np.zeros((bands, *size), bool)
    meta = {m.path: m for m in spark.read.format("geotiff").option("mode", "metadata").load(str(path)).collect()}
    for t in spark.read.format("geotiff").option("samples", "stored").load(str(path)).collect():
        m = meta[t.path]
        x, y = round((m.c - origin[0]) / 2) + t.x, round((origin[1] - m.f) / 2) + t.y
        out[t.band - 1, y : y + t.h, x : x + t.w] = np.frombuffer(t.samples, dtype).reshape(t.h, t.w)
        good[t.band - 1, y : y + t.h, x : x + t.w] = True if t.valid is None else np.unpackbits(np.frombuffer(t.valid, np.uint8))[: t.h * t.w].reshape(t.h, t.w)
    return out, good


@pytest.mark.parametrize("dtype", ["uint8", "int8", "uint16", "int32", "uint32", "float32", "float64"])
@pytest.mark.parametrize("policy", ["first", "last"])
def test_masked_files_merge_right(spark, tmp_path, dtype, policy):
    r = np.random.default_rng(4)
    want, have = np.zeros((40, 60), dtype), np.zeros((40, 60), bool)
    parts = [(0, 0, 30, 40), (20, 10, 25, 33), (50, 0, 40, 10)]
    for i, (x, y, h, w) in enumerate(parts):
        a = r.integers(0, 120, (h, w)).astype(dtype)
        if np.dtype(dtype).kind == "f":
            a[0, :3] = [-0.0, np.nan, np.inf]
        good = r.random((h, w)) < 0.6
        put(spark, tmp_path / "in", f"s{i}", [a], x, y, good, compression="zstd", predictor=1)
        there = want[y : y + h, x : x + w], have[y : y + h, x : x + w]
        take = good if policy == "last" else good & ~there[1]
        there[0][take] = a[take]
        there[1][good] = True
    report = jobs.merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), policy, edge=16, block_tiles=2).first()
    assert (report.expected, report.found, report.missing, report.unexpected, report.different) == (have.sum(), have.sum(), 0, 0, 0)
    got, good = whole(spark, tmp_path / "out", dtype)
    assert np.array_equal(good[0], have)
    assert got[0][have].tobytes() == want[have].tobytes()
    meta = spark.read.format("geotiff").option("mode", "metadata").load(str(tmp_path / "out")).collect()
    assert all(m.masked and m.levels == 0 for m in meta)
    assert jobs.without_overviews(spark, str(tmp_path / "out")).count() == len(meta) > 1


def handmade(tmp_path, name, a, mask_bits=None, order="<", keys=None, nodata=None):
    """A file in strips of three rows without compression, and a mask directory of one strip."""
    h, w = a.shape
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    strips = [a[i : i + 3].astype(a.dtype.newbyteorder(order)).tobytes() for i in range(0, h, 3)]
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [a.itemsize * 8]), (259, "H", [1]), (262, "H", [1]), (273, "I", None), (277, "H", [1]), (278, "I", [3]), (279, "I", [len(s) for s in strips]), (339, "H", [kind])]
    tags += [(33550, "d", [2.0, 2.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 100.0, 200.0, 0.0])]
    tags += [(34735, "H", keys[0]), (34736, "d", keys[1]), (34737, "s", [keys[2]])] if keys else []
    tags += [(42113, "s", [nodata.encode() + b"\0"])] if nodata else []
    sets = [(tags, strips)]
    if mask_bits is not None:
        packed = np.packbits(mask_bits, axis=1).tobytes()
        sets.append(([(254, "I", [4]), (256, "I", [w]), (257, "I", [h]), (258, "H", [1]), (259, "H", [1]), (262, "H", [4]), (273, "I", None), (277, "H", [1]), (278, "I", [h]), (279, "I", [len(packed)])], [packed]))
    out, at = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8)), 8
    for k, (found, data) in enumerate(sets):
        entries, size = sorted(found), 2 + 12 * len(found) + 4
        extra, cells = b"", b""
        start = at + size
        room = sum(len(struct.pack(f"{order}{len(v or data)}I", *[0] * len(v or data))) if f == "I" else len(v[0]) if f == "s" else struct.calcsize(f) * len(v) for _, f, v in entries) + 64
        offsets = [start + room + sum(len(s) for s in data[:i]) for i in range(len(data))]
        for tag, form, values in entries:
            values = offsets if values is None else values
            raw = values[0] if form == "s" else struct.pack(f"{order}{len(values)}{form}", *values)
            n = len(raw) if form == "s" else len(values)
            cells += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[form], n)
            cells += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", start + len(extra))
            extra += raw if len(raw) > 4 else b""
        body = extra.ljust(room, b"\0") + b"".join(data)
        following = start + len(body) if k + 1 < len(sets) else 0
        out += struct.pack(order + "H", len(entries)) + cells + struct.pack(order + "I", following) + body
        at = following
    tmp_path.mkdir(exist_ok=True)
    (tmp_path / f"{name}.tif").write_bytes(bytes(out))


@pytest.mark.parametrize("order", ["<", ">"])
def test_masks_of_other_writers(spark, tmp_path, order):
    geotiff.register(spark)
    a = np.arange(77).reshape(7, 11).astype("int16")
    bits = (a % 3 > 0).astype(np.uint8)
    handmade(tmp_path / "in", "m", a, bits, order)
    m = spark.read.format("geotiff").option("mode", "metadata").load(str(tmp_path / "in")).first()
    assert (m.masked, m.levels, m.dtype) == (True, 0, "int16")
    got, good = whole(spark, tmp_path / "in", "int16", size=(7, 11))
    assert np.array_equal(got[0], a) and np.array_equal(good[0], bits > 0)
    cells = spark.read.format("geotiff").load(str(tmp_path / "in")).collect()
    assert sum(np.frombuffer(c.valid, np.uint8).sum() for c in cells) == bits.sum()
    # a mask file beside a raster, of whole bytes
    handmade(tmp_path / "two", "b", a, None, order)
    handmade(tmp_path, "mask", (bits * 255).astype("uint8"), None, "<")
    (tmp_path / "mask.tif").rename(tmp_path / "two" / "b.tif.msk")
    assert np.array_equal(whole(spark, tmp_path / "two", "int16", size=(7, 11))[1][0], bits > 0)
    r = jobs.merge(spark, str(tmp_path / "two"), str(tmp_path / "out"), edge=16).first()
    assert (r.expected, r.missing, r.unexpected, r.different) == (bits.sum(), 0, 0, 0)


def test_masks_that_cannot_be_kept_are_refused(spark, tmp_path):
    a = np.arange(1, 401).reshape(20, 20).astype("int16")
    a[3, 3] = -1
    put(spark, tmp_path / "in", "a", [a], valid=np.ones((20, 20), bool), nodata="-1")
    with pytest.raises(jobs.InputError, match="NoData values marked valid"):
        jobs.merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), edge=16)
    assert not list((tmp_path / "out").glob("*.tif"))
    # outside of a strict job such samples aren't valid
    assert not whole(spark, tmp_path / "in", "int16")[1][0][3, 3]
    two = np.ones((2, 20, 20), bool)
    two[1, 5, 5] = False
    with pytest.raises(Exception, match="bands of different masks"):
        put(spark, tmp_path / "bands", "b", [a, a], valid=two)


def test_types_are_kept_or_refused(spark, tmp_path):
    big = np.array([[2**53 + 1, 5], [7, -(2**62)]], "int64")
    handmade(tmp_path / "big", "b", big)
    with pytest.raises(jobs.InputError, match="64-bit"):
        jobs.merge(spark, str(tmp_path / "big"), str(tmp_path / "o1"), edge=16)
    with pytest.raises(Exception, match="64-bit"):
        spark.read.format("geotiff").load(str(tmp_path / "big")).collect()
    assert np.array_equal(whole(spark, tmp_path / "big", "int64", size=(2, 2))[0][0], big)
    put(spark, tmp_path / "bytes", "a", [np.full((20, 20), 7, "uint8")])
    put(spark, tmp_path / "bytes", "b", [np.full((20, 20), 9, "uint8")], 30, 0)
    for bad in (-9999, 256, 1.5, float("nan")):
        with pytest.raises(jobs.InputError, match="can't hold"):
            jobs.merge(spark, str(tmp_path / "bytes"), str(tmp_path / "o2"), edge=16, nodata=bad)
    assert not (tmp_path / "o2").exists()
    r = jobs.merge(spark, str(tmp_path / "bytes"), str(tmp_path / "o3"), edge=16, nodata=255).first()
    assert (r.expected, r.found) == (800, 800)
    put(spark, tmp_path / "clash", "a", [np.array([[1, 255]], "uint8")])
    put(spark, tmp_path / "clash", "b", [np.array([[1, 2]], "uint8")], 5, 0)
    with pytest.raises(jobs.InputError, match="1 samples missing"):
        jobs.merge(spark, str(tmp_path / "clash"), str(tmp_path / "o4"), edge=16, nodata=255)
    assert not list((tmp_path / "o4").glob("*.tif"))


def test_representable():
    fits = geotiff.representable
    assert fits(255, "uint8") and fits(-1, "int8") and fits(float("nan"), "float32") and fits(0.5, "float32") and fits(float("-inf"), "float64")
    assert not (fits(256, "uint8") or fits(0.5, "int16") or fits(0.1, "float32") or fits(1e300, "float32") or fits(float("nan"), "uint8") or fits(float("inf"), "int32"))


#: GeoKeys of a system of its own: what it is, pixels, the name, an ellipsoid's axes and a projection's parameters.
OWN = [1, 1, 0, 6, 1024, 0, 1, 1, 1025, 0, 1, 1, 1026, 34737, 8, 0, 2057, 34736, 1, 0, 3080, 34736, 1, 1, 3072, 0, 1, 32767]


def test_coordinate_systems_are_kept_and_compared_by_their_keys(spark, tmp_path):
    a = np.arange(400).reshape(20, 20).astype("uint16")
    keys = lambda x, name=b"My grid|": (OWN, [6378137.0, x], name + b"\0")
    handmade(tmp_path / "in", "a", a, keys=keys(9.0))
    handmade(tmp_path / "in", "b", a, keys=keys(9.0, b"Other n|"))
    jobs.merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), edge=16)
    m = spark.read.format("geotiff").option("mode", "metadata").load(str(tmp_path / "out")).first()
    first = spark.read.format("geotiff").option("mode", "metadata").load(str(tmp_path / "in")).orderBy("path").first()
    assert (m.crs, m.geo, m.system) == ("My grid", first.geo, first.system)
    handmade(tmp_path / "in", "c", a, keys=keys(10.0))
    with pytest.raises(jobs.InputError, match="coordinate system"):
        jobs.inventory(spark, str(tmp_path / "in"))
    handmade(tmp_path / "none", "a", a, keys=keys(9.0))
    handmade(tmp_path / "none", "b", a)
    with pytest.raises(jobs.InputError, match="coordinate system"):
        jobs.inventory(spark, str(tmp_path / "none"))


def test_kinds_of_codes():
    kind = lambda *a: geotiff.geo_keys(*a)[7]
    assert [kind("EPSG:4326"), kind("EPSG:7844"), kind("EPSG:6318"), kind("EPSG:3857"), kind("EPSG:32636"), kind("EPSG:4087", "projected"), kind("EPSG:4647", "projected")] == [2, 2, 2, 1, 1, 1, 1]
    with pytest.raises(ValueError, match="crs_kind"):
        geotiff.geo_keys("EPSG:4087")


def test_points_and_areas(spark, tmp_path):
    a = np.arange(400).reshape(20, 20).astype("uint16")
    area, point = [1, 1, 0, 2, 1024, 0, 1, 1, 1025, 0, 1, 1], [1, 1, 0, 2, 1024, 0, 1, 1, 1025, 0, 1, 2]
    handmade(tmp_path / "in", "a", a, keys=(area, [0.0], b"|\0"))
    handmade(tmp_path / "p", "b", a, keys=(point, [0.0], b"|\0"))
    geotiff.register(spark)
    m = spark.read.format("geotiff").option("mode", "metadata").load(str(tmp_path / "p")).first()
    assert (m.point, m.c, m.f) == (True, 99.0, 201.0)
    jobs.merge(spark, str(tmp_path / "p"), str(tmp_path / "out"), edge=16)
    n = spark.read.format("geotiff").option("mode", "metadata").load(str(tmp_path / "out")).first()
    assert (n.point, n.c, n.f) == (True, 99.0, 201.0)
    handmade(tmp_path / "in", "c", a, keys=(point, [0.0], b"|\0"))
    with pytest.raises(jobs.InputError, match="points and areas"):
        jobs.inventory(spark, str(tmp_path / "in"))


def test_the_least_conflict_is_counted_whole(spark, tmp_path):
    r = np.random.default_rng(6)
    parts = [(r.integers(0, 4, (30, 40)).astype("uint8"), x, y) for x, y in ((0, 0), (10, 5), (20, 10), (5, 20))]
    parts[1][0][:] = 0
    parts[0][0][5:, 10:] = 0
    for i, (a, x, y) in enumerate(parts):
        put(spark, tmp_path, f"s{i}", [a], x, y)
    place = jobs.inventory(spark, str(tmp_path)).select("path", "ord", F.col("x").alias("ox"), F.col("y").alias("oy"))
    read = spark.read.format("geotiff").option("samples", "stored").load(str(tmp_path)).join(place, "path")
    read = read.withColumns({"x": F.col("x") + F.col("ox"), "y": F.col("y") + F.col("oy")})
    got = windows.conflicts(windows.parts(read, 16, "uint8"), 16, "uint8").orderBy("first", "second").first()
    best = None
    for i in range(4):
        for j in range(i + 1, 4):
            off = {(y, x) for y in range(60) for x in range(60) if all(0 <= y - p[2] < 30 and 0 <= x - p[1] < 40 for p in (parts[i], parts[j])) and parts[i][0][y - parts[i][2], x - parts[i][1]] != parts[j][0][y - parts[j][2], x - parts[j][1]]}
            best = best or (off and (i, j, len(off), *min(off), 1)) or None
    assert tuple(got) == best
    with pytest.raises(jobs.InputError, match=f"sources {best[0]} and {best[1]} differ in {best[2]} samples, first at {best[4]}, {best[3]}"):
        jobs.merge(spark, str(tmp_path), str(tmp_path / "out"), "error", edge=16)


def test_a_stopped_merge_goes_on(spark, tmp_path):
    r = np.random.default_rng(5)
    for i in range(3):
        put(spark, tmp_path / "in", f"s{i}", [r.integers(0, 99, (40, 40)).astype("int16")], 40 * i, 0)
    source, out = str(tmp_path / "in"), tmp_path / "out"
    go = lambda **more: jobs.merge(spark, source, str(out), edge=16, block_tiles=1, resume=True, **more).first()
    whole_report = go()
    made = {p.name: (p.stat().st_mtime_ns, p.read_bytes()) for p in out.glob("*.tif")}
    state = {p.name for p in (out / "_state" / "blocks").glob("*.json")}
    assert len(made) == len(state) == 24
    # as if it had been killed: one block is gone, one has no row of state, one was cut short, one has changed
    names = sorted(made)
    (out / names[0]).unlink()
    (out / "_state" / "blocks" / names[1].replace("tif", "json")).unlink()
    (out / names[2]).write_bytes(made[names[2]][1][:-9])
    changed = bytearray(made[names[3]][1])
    changed[-1] ^= 1
    (out / names[3]).write_bytes(bytes(changed))
    assert go() == whole_report
    again = {p.name: (p.stat().st_mtime_ns, p.read_bytes()) for p in out.glob("*.tif")}
    assert {n: b for n, (_, b) in again.items()} == {n: b for n, (_, b) in made.items()}
    assert {n for n in names if again[n][0] != made[n][0]} == set(names[:4])
    assert go() == whole_report
    assert {p.name: p.stat().st_mtime_ns for p in out.glob("*.tif")} == {n: t for n, (t, _) in again.items()}
    with pytest.raises(jobs.InputError, match="other inputs or options"):
        go(predictor=2)
    (out / "stray.tif").write_bytes(made[names[0]][1])
    with pytest.raises(jobs.InputError, match="stray"):
        go()
    other = tmp_path / "other"
    other.mkdir()
    (other / "x.tif").write_bytes(made[names[0]][1])
    with pytest.raises(jobs.InputError, match="no state"):
        jobs.merge(spark, source, str(other), edge=16, resume=True)


def test_blocks_are_kept_when_the_job_dies(spark, tmp_path):
    r = np.random.default_rng(5)
    put(spark, tmp_path / "in", "s", [r.integers(0, 99, (40, 40)).astype("int16")])
    (tmp_path / "in" / "t.tif").write_bytes((tmp_path / "in" / "s.tif").read_bytes())
    put(spark, tmp_path / "in", "z", [r.integers(0, 99, (40, 40)).astype("int16")], 40, 0)
    data = (tmp_path / "in" / "z.tif").read_bytes()
    (tmp_path / "in" / "z.tif").write_bytes(data[:-400])  # its last tiles can't be read
    with pytest.raises(Exception):
        jobs.merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), edge=16, block_tiles=1, resume=True)
    (tmp_path / "in" / "z.tif").write_bytes(data)
    assert json.loads((tmp_path / "out" / "_state" / "plan.json").read_text())["signature"]
    report = jobs.merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), edge=16, block_tiles=1, resume=True).first()
    assert report.expected == report.found == 3200


def test_places_beyond_scale_factor_one(spark):
    kind = "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity long"
    keys = [(1, 2**21, 1, 5, 1), (2, 0, 1, 5, 1), (32768, 1, 1, 1, 1), (10**9, 6 * 10**11, 7, 2 * 10**10, 50), (10**9, 6 * 10**11, 7, 2 * 10**10, 51), (1, 2**39, 7, 3, 2)]
    rows = spark.createDataFrame(keys, kind).select("*", views._place().alias("ord")).orderBy("ord").collect()
    assert [tuple(r)[:5] for r in rows] == sorted(keys) and len({r["ord"] for r in rows}) == len(keys)
    with pytest.raises(Exception, match="beyond"):
        spark.createDataFrame([(1, 10**12, 1, 1, 1)], kind).select(views._place()).collect()


def test_only_shares_of_large_files_are_read(tmp_path, spark):
    put(spark, tmp_path, "a", [np.arange(6400).reshape(80, 80).astype("int16")], compression="none")
    reader = geotiff.GeoTiffReader({"path": str(tmp_path), "samples": "stored", "partition_bytes": "3000"})
    parts = reader.partitions()
    rows = [row for p in parts for batch in reader.read(p) for row in batch.to_pylist()]
    assert len(parts) == 5 and len(rows) == 25 == len({(r["x"], r["y"]) for r in rows})


def levels_of(path, dtype):
    """Samples and masks of the directories of a file, by hand from its tiles."""
    with open(path, "rb") as stream:
        out = []
        for tags in geotiff.directories(stream):
            d = geotiff.described(tags)
            (edge, _), bands = d["tile"], d["bands"]
            w, h = -(-d["width"] // edge), -(-d["height"] // edge)
            made = np.zeros((bands, h * edge, w * edge), bool if d["bits"] == 1 else dtype)
            for i in range(len(d["offsets"])):
                band, at = divmod(i, w * h)
                ty, tx = divmod(at, w)
                if d["counts"][i]:
                    made[band, ty * edge : ty * edge + edge, tx * edge : tx * edge + edge] = geotiff.stored_tile(stream, d, i)[:, :, 0]
                else:
                    made[band, ty * edge : ty * edge + edge, tx * edge : tx * edge + edge] = d["nodata"] or 0
            out.append((tags.get(254, (0,))[0], made[:, : d["height"], : d["width"]]))
    return out


@pytest.mark.parametrize(("method", "dtype", "how"), [("average", "uint8", "nodata"), ("nearest", "int16", "nodata"), ("average", "float32", "mask"), ("average", "uint16", "none"), ("nearest", "uint8", "mask")])
def test_overviews_beside_files(spark, tmp_path, method, dtype, how):
    r = np.random.default_rng(9)
    bands = [r.integers(1, 99, (75, 130)).astype(dtype) for _ in range(2)]
    good = np.ones((75, 130), bool)
    if how != "none":
        good = r.random((75, 130)) < 0.7
        good[16:64, 32:96] = False
    if how == "nodata":
        for b in bands:
            b[~good] = 99
    more = {"nodata": "99"} if how == "nodata" else {}
    put(spark, tmp_path, "a", bands, valid=good if how == "mask" else None, **more)
    put(spark, tmp_path, "small", [bands[0][:10, :16]], **({"nodata": "99"} if how == "nodata" else {}))
    put(spark, tmp_path, "inside", [np.zeros((40, 40), dtype)], overviews="nearest", **more)
    for suffix in (".ovr", ".rrd", ".aux"):
        (tmp_path / f"a.tif{suffix}").write_bytes(b"stale")
    got = jobs.external_overviews(spark, str(tmp_path), method, least=16, edge=16)
    assert {(x.path.rsplit("/", 1)[1], x.status, x.levels) for x in got.collect()} == {("a.tif", "ok", 4), ("small.tif", "small", 0), ("inside.tif", "internal", 0)}
    assert sorted(p.name for p in tmp_path.iterdir() if p.name != "_tmp") == ["a.tif", "a.tif.ovr", "inside.tif", "small.tif"]
    found = levels_of(tmp_path / "a.tif.ovr", dtype)
    wants = [(b.astype(float), good) for b in bands]
    for k in range(4):
        kind, made = found[k]
        mask = found[4 + k][1][0] if how == "mask" else None
        for b in range(2):
            x, v = wants[b]
            pad = ((0, x.shape[0] % 2), (0, x.shape[1] % 2))
            x, v = np.pad(x, pad), np.pad(v, pad)
            fours = [(x[i::2, j::2], v[i::2, j::2]) for i in (0, 1) for j in (0, 1)]
            n = sum(g.astype(int) for _, g in fours)
            mean = sum(np.where(g, a.astype(float), 0) for a, g in fours) / np.maximum(n, 1)
            mean = np.rint(mean) if dtype != "float32" else mean.astype("float32")
            x, v = (mean, n > 0) if method == "average" else fours[0]
            wants[b] = x, v
            assert kind == 1 and made[b].shape == x.shape
            assert np.array_equal(made[b][v], x[v].astype(dtype)), (k, b)
            if how == "nodata":
                assert (made[b][~v] == 99).all()
            if mask is not None:
                assert found[4 + k][0] == 5 and np.array_equal(mask, v)
    again = jobs.external_overviews(spark, str(tmp_path), method, least=16, edge=16)
    assert again.count() == 3


def test_palettes_are_not_averaged(spark, tmp_path):
    put(spark, tmp_path, "p", [np.ones((40, 40), "uint8")])
    data = bytearray((tmp_path / "p.tif").read_bytes())
    at = int.from_bytes(data[4:8], "little")
    for i in range(int.from_bytes(data[at : at + 2], "little")):
        entry = at + 2 + 12 * i
        if int.from_bytes(data[entry : entry + 2], "little") == 262:
            data[entry + 8 : entry + 10] = (3).to_bytes(2, "little")
    (tmp_path / "p.tif").write_bytes(bytes(data))
    with pytest.raises(jobs.InputError, match="palette"):
        jobs.external_overviews(spark, str(tmp_path), "average", least=16, edge=16)
    assert jobs.external_overviews(spark, str(tmp_path), "nearest", least=16, edge=16).first().status == "ok"


class Counted:
    """A file that notes which ranges it is asked for."""

    def __init__(self, data):
        self.data, self.at, self.ranges = data, 0, []

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.ranges.append((self.at, n))
        return self.data[self.at : self.at + n]


def test_neighbouring_tiles_are_asked_for_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(geotiff, "HEAD_BYTES", 4096)
    monkeypatch.setattr(geotiff, "GAP_BYTES", 600)
    a = np.random.default_rng(1).integers(0, 60000, (160, 160)).astype("uint16")
    put(spark, tmp_path, "a", [a], compression="none")
    data = (tmp_path / "a.tif").read_bytes()
    file = Counted(data)
    ranges = geotiff.Ranges(file)
    reader = geotiff.GeoTiffReader({"path": str(tmp_path), "samples": "stored", "window": "32,48,48,48"})
    rows = list(reader._rows("a.tif", ranges, None, geotiff._Part(["a.tif"])))
    assert len(rows) == 9 and all(np.array_equal(np.frombuffer(r[6], "uint16").reshape(16, 16), a[r[3] : r[3] + 16, r[2] : r[2] + 16]) for r in rows)
    assert len(file.ranges) == 1 + 3 and sum(n for _, n in file.ranges[1:]) == 9 * 512  # a row of three tiles is one range
    monkeypatch.setattr(geotiff, "GAP_BYTES", 10_000)
    file = Counted(data)
    assert len(list(reader._rows("a.tif", geotiff.Ranges(file), None, geotiff._Part(["a.tif"])))) == 9
    assert len(file.ranges) == 2 and sum(n for _, n in file.ranges) < len(data) / 2


def test_an_index_spares_files(spark, tmp_path, monkeypatch):
    for i in range(6):
        put(spark, tmp_path, f"s{i}", [np.full((20, 20), i, "uint8")], 20 * i, 0)
    index = jobs.footprints(spark, str(tmp_path))
    assert [(r.west, r.south, r.east, r.north) for r in index.orderBy("west").collect()][:2] == [(100.0, 160.0, 140.0, 200.0), (140.0, 160.0, 180.0, 200.0)]
    for name in ("s0", "s5"):
        (tmp_path / f"{name}.tif").write_bytes(b"not read")
    kept = index.where("false")
    index = spark.createDataFrame([(f"{tmp_path}/s{i}.tif", 100.0 + 40 * i, 160.0, 140.0 + 40 * i, 200.0) for i in range(6)], kept.schema)
    got = jobs.window(spark, str(tmp_path), index, (150.0, 170.0, 230.0, 180.0), stored=True).collect()
    assert sorted((r.path[-6:-4], r.x, r.y) for r in got) == [("s1", 0, 0), ("s1", 16, 0), ("s2", 0, 0), ("s2", 16, 0), ("s3", 0, 0)]
    assert jobs.window(spark, str(tmp_path), index, (0.0, 0.0, 1.0, 1.0)).count() == 0


def test_results_of_earlier_jobs(spark, tmp_path):
    def tile(folder, name, dtype="int16", nodata="-9999", grid="9.9995833,0.000833333333333333,0,50.00041666666667,0,-0.000833333333333333", **more):
        geotiff.register(spark)
        rows = [(name, 1, 0, 0, np.zeros((16, 16), dtype).tobytes(), None)]
        spark.createDataFrame(rows, WIDE).write.format("geotiff").mode("append").options(path=str(tmp_path / folder), edge=16, width=16, height=16, bands=1, dtype=dtype, samples="stored", nodata=nodata, grid=grid, crs="EPSG:4326", **more).save()

    grid = lambda c, f: f"{c!r},{1 / 1200!r},0,{f!r},0,{-1 / 1200!r}"
    half = 0.5 / 1200
    tile("in", "a", grid=grid(10 - half, 50 + half))
    tile("in", "b", grid=grid(10 - half + 16 / 1200, 50 + half))
    rows = jobs.results(spark, str(tmp_path / "in")).orderBy("ord").collect()
    assert [round(r.per_degree, 6) for r in rows] == [1200.0, 1200.0] and rows[0].west == pytest.approx(10.0) and rows[0].south == pytest.approx(50 - 15 / 1200) and rows[1].x == 16
    tile("bytes", "a", "uint8", "9", grid=grid(10 - half, 50 + half))
    with pytest.raises(jobs.InputError, match="int16 or float32"):
        jobs.results(spark, str(tmp_path / "bytes"))
    tile("off", "a", grid=f"10.0001,{1 / 1200!r},0,50,0,{-1 / 1200!r}")
    with pytest.raises(jobs.InputError, match="whole samples"):
        jobs.results(spark, str(tmp_path / "off"))


def test_metadata_items():
    text = b'<GDALMetadata><Item name="A">1</Item><Item name="STATISTICS_MEAN" sample="0">2</Item><Item name="OFFSET" sample="0" role="offset">3</Item></GDALMetadata>\0'
    assert geotiff.metadata_items({42112: (text,)}) == {"A": "1", "STATISTICS_MEAN|0": "2", "OFFSET|0|offset": "3"}
    assert geotiff.metadata_items({}) == {} == geotiff.metadata_items({42112: (b'<!DOCTYPE x [<!ENTITY a "b">]><x/>\0',)})


def test_links_are_left_out(spark, tmp_path):
    import os

    from gridloom.sources import files

    for name in ("a.tif", "b.tif", "c.tif"):
        (tmp_path / name).write_bytes(name.encode() * 9)
    os.link(tmp_path / "b.tif", tmp_path / "hard.tif")
    os.symlink(tmp_path / "a.tif", tmp_path / "soft.tif")
    listed = spark.createDataFrame([(f"{tmp_path}/{n}", 1) for n in ("a.tif", "b.tif", "c.tif", "hard.tif", "soft.tif")], "path string, size int")
    assert sorted(r.path[-5:] for r in files.unlinked(listed).collect()) == ["a.tif", "c.tif"]


def test_settings_are_checked_first(spark, tmp_path):
    put(spark, tmp_path / "in", "a", [np.zeros((16, 16), "uint8")])
    for more, said in (({"compression": "zstd", "level": 23}, "levels"), ({"compression": "packbits", "predictor": 2}, "predictor"), ({"predictor": 3}, "floating"), ({"compression": "jpeg"}, "unknown")):
        with pytest.raises(jobs.InputError, match=said):
            jobs.merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), edge=16, **more)


def test_commands(spark, tmp_path, capsys):
    from gridloom.__main__ import main

    put(spark, tmp_path / "in", "a", [np.arange(400).reshape(20, 20).astype("int16")], nodata="-1")
    main(["merge", str(tmp_path / "in"), str(tmp_path / "out"), "--edge", "16", "--block-tiles", "1", "--resume", "--level", "3"])
    main(["overviews", str(tmp_path / "in"), "--min-size", "8", "--resampling", "nearest"])
    for what in ("inventory", "structure"):
        main([what, str(tmp_path / "out")])
    main(["window", str(tmp_path / "in"), "100", "190", "110", "200"])
    main(["plan", str(tmp_path / "in"), "100"])
    said = capsys.readouterr().out
    assert len(list((tmp_path / "out").glob("*.tif"))) == 4 and (tmp_path / "in" / "a.tif.ovr").exists()
    assert "different" in said and "block_0001_0001.tif" in said and "|ok " in said
    with pytest.raises(SystemExit):
        main(["merge"])
