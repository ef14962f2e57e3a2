"""Merging files end to end, with an independent merge in numpy."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, IsNotNull, LessThan

from gridloom.operators import tiles
from gridloom.plans import jobs
from gridloom.sources import geotiff


def put(spark, path, name, a, x, y, nodata="-1", dtype="int16", **more):
    geotiff.register(spark)
    h, w = a.shape
    rows = [(0, 0, 1, c, r, float(a[r, c]), True) for r in range(h) for c in range(w)]
    packed = tiles.pack(spark.createDataFrame(rows, "src long, ord long, band int, x long, y long, v double, valid boolean"), 16)
    packed = packed.select(F.lit(name).alias("block"), "band", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), "samples")
    packed.repartition("block").write.format("geotiff").mode("append").options(path=str(path), edge=16, width=w, height=h, bands=1, dtype=dtype, nodata=nodata, grid=f"{100 + 2 * x},2,0,{200 - 2 * y},0,-2", **more).save()


@pytest.fixture
def files(spark, tmp_path):
    rng = np.random.default_rng(3)
    parts = [(rng.integers(0, 99, (30, 40)), 0, 0), (rng.integers(0, 99, (25, 30)), 25, 10), (rng.integers(0, 99, (20, 20)), -5, 20)]
    for i, (a, x, y) in enumerate(parts):
        a[3:6, 4:9] = -1
        put(spark, tmp_path / "in", f"s{i}", a, x, y)
    return tmp_path, parts


@pytest.mark.parametrize("policy", ["first", "last"])
def test_merge(spark, files, policy):
    path, parts = files
    report = jobs.merge(spark, str(path / "in"), str(path / "out"), policy, edge=16, block_tiles=2, compression="zstd", predictor=2)
    r = report.first()
    assert r.missing == r.unexpected == r.different == 0
    want = np.full((40, 60), -1)
    for a, x, y in parts if policy == "last" else parts[::-1]:
        there = want[y : y + a.shape[0], x + 5 : x + 5 + a.shape[1]]
        there[a != -1] = a[a != -1]
    got = np.full((40, 60), -1)
    meta = {m.path: m for m in jobs.inventory(spark, str(path / "out")).collect()}
    for t in spark.read.format("geotiff").load(str(path / "out")).collect():
        m = meta[t.path]
        left, top = round((m.c - 90) / 2), round((200 - m.f) / 2)
        got[top + t.y : top + t.y + t.h, left + t.x : left + t.x + t.w] = np.frombuffer(t.samples).reshape(t.h, t.w)
    assert (got == want).all() and len(meta) == 4
    assert r.expected == (want != -1).sum()


def test_merge_refuses(spark, files):
    path, parts = files
    with pytest.raises(jobs.InputError, match="differ in"):
        jobs.merge(spark, str(path / "in"), str(path / "out"), "error", edge=16)
    assert not (path / "out").exists()
    put(spark, path / "in", "z", parts[0][0], 0.5, 0)
    with pytest.raises(jobs.InputError, match="aligned"):
        jobs.inventory(spark, str(path / "in"))
    put(spark, path / "in", "t", parts[0][0], 0, 0, dtype="float32")
    with pytest.raises(jobs.InputError, match="another type"):
        jobs.inventory(spark, str(path / "in"))


def test_plan_and_overviews(spark, files):
    path, _ = files
    assert jobs.plan(spark, str(path / "in"), 500).count() > 2
    levels = jobs.overviews(spark, str(path / "in"), 16)
    assert levels.agg(F.max("level")).first()[0] == 2


def test_jobs_can_be_stopped(spark):
    done = jobs.Job(spark, lambda s: s.range(10).count())
    assert done.result(60) == 10 and done.status() == "done"
    slow = jobs.Job(spark, lambda s: s.range(1 << 40).where("hash(id) = 1 and hash(id, 1) = 2 and hash(id, 2) = 3").count())
    time.sleep(3)
    assert slow.status() == "running"
    slow.cancel()
    with pytest.raises(Exception):
        slow.result(60)
    assert slow.status() == "cancelled"


def retagged(path, tag, value):
    """The file with one 16-bit tag of its first directory set to another value."""
    data = bytearray(path.read_bytes())
    at = int.from_bytes(data[4:8], "little")
    for i in range(int.from_bytes(data[at : at + 2], "little")):
        entry = at + 2 + 12 * i
        if int.from_bytes(data[entry : entry + 2], "little") == tag:
            data[entry + 8 : entry + 10] = value.to_bytes(2, "little")
    path.write_bytes(data)


def test_coordinate_systems_alpha_and_palettes(spark, tmp_path):
    a = np.arange(400).reshape(20, 20)
    put(spark, tmp_path / "in", "a", a, 0, 0, crs="EPSG:3857")
    put(spark, tmp_path / "in", "b", a, 20, 0, crs="EPSG:3857")
    jobs.merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), edge=16, block_tiles=4)
    assert {m.crs for m in jobs.inventory(spark, str(tmp_path / "out")).collect()} == {"EPSG:3857"}
    put(spark, tmp_path / "in", "c", a, 40, 0, crs="EPSG:4326")
    with pytest.raises(jobs.InputError, match="coordinate system"):
        jobs.inventory(spark, str(tmp_path / "in"))
    put(spark, tmp_path / "palette", "p", a, 0, 0)
    retagged(tmp_path / "palette" / "p.tif", 262, 3)
    with pytest.raises(jobs.InputError, match="palette"):
        jobs.inventory(spark, str(tmp_path / "palette"))
    rows = [(0, 0, band, c, r, 1.0, True) for band in (1, 2) for r in range(16) for c in range(16)]
    packed = tiles.pack(spark.createDataFrame(rows, "src long, ord long, band int, x long, y long, v double, valid boolean"), 16).select(F.lit("q").alias("block"), "band", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), "samples")
    packed.repartition("block").write.format("geotiff").mode("append").options(path=str(tmp_path / "alpha"), edge=16, width=16, height=16, bands=2, dtype="uint8").save()
    assert jobs.inventory(spark, str(tmp_path / "alpha")).count() == 1
    retagged(tmp_path / "alpha" / "q.tif", 338, 2)
    with pytest.raises(jobs.InputError, match="alpha"):
        jobs.inventory(spark, str(tmp_path / "alpha"))


@pytest.mark.parametrize("big", ["auto", "yes"])
@pytest.mark.parametrize("method", ["average", "nearest"])
def test_overviews_inside_files(spark, tmp_path, method, big):
    rng = np.random.default_rng(8)
    a = rng.integers(0, 900, (53, 70))
    a[10:30, 5:25] = -1
    put(spark, tmp_path, "o", a, 0, 0, overviews=method, bigtiff=big)
    with open(tmp_path / "o.tif", "rb") as stream:
        levels = geotiff.directories(stream)
        found = []
        for tags in levels:
            d = geotiff.described(tags)
            out = np.zeros((-(-d["height"] // 16) * 16, -(-d["width"] // 16) * 16))
            across = -(-d["width"] // 16)
            for i, (at, n) in enumerate(zip(d["offsets"], d["counts"], strict=True)):
                stream.seek(at)
                tile = geotiff.restored(geotiff.decoded(stream.read(n), d["codec"], 512), d["dtype"], 16, 16, 1, 1)[:, :, 0]
                out[i // across * 16 : i // across * 16 + 16, i % across * 16 : i % across * 16 + 16] = tile
            found.append(out[: d["height"], : d["width"]])
    want = [a.astype(float)]
    while max(want[-1].shape) > 16:
        b = np.where(want[-1] == -1, np.nan, want[-1])
        b = np.pad(b, ((0, b.shape[0] % 2), (0, b.shape[1] % 2)), constant_values=np.nan)
        four = np.stack([b[::2, ::2], b[::2, 1::2], b[1::2, ::2], b[1::2, 1::2]])
        n = (~np.isnan(four)).sum(axis=0)
        mean = np.where(n > 0, np.rint(np.nansum(four, axis=0) / np.maximum(n, 1)), np.nan)
        want.append(np.nan_to_num(mean if method == "average" else four[0], nan=-1))
    assert len(found) == len(want) == 4 and all((x == y).all() for x, y in zip(found, want, strict=True))
    assert [tuple(r) for r in jobs.structure(spark, str(tmp_path)).select("faults", "valid").collect()] == [([], True)]
    assert jobs.without_overviews(spark, str(tmp_path)).count() == 0
    put(spark, tmp_path, "plain", a, 0, 0)
    assert [r.path.rsplit("/", 1)[1] for r in jobs.without_overviews(spark, str(tmp_path)).collect()] == ["plain.tif"]


def test_filters_reach_the_stored_tiles(spark, tmp_path):
    put(spark, tmp_path, "a", np.arange(1600).reshape(40, 40), 0, 0)
    read = spark.read.format("geotiff").load(str(tmp_path))
    some = read.where("x >= 16 and y < 16 and band = 1")
    assert sorted((r.x, r.y) for r in some.collect()) == [(16, 0), (32, 0)]
    reader = geotiff.GeoTiffReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([GreaterThanOrEqual(("x",), 16), LessThan(("y",), 16), IsNotNull(("x",))])) == [IsNotNull(("x",))]
    rows = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert sorted((row["x"], row["y"]) for row in rows) == [(16, 0), (32, 0)]
    assert read.where("band = 2").count() == 0


def test_files_appear_together_or_not_at_all(spark, tmp_path):
    a = np.arange(256).reshape(16, 16)
    put(spark, tmp_path, "b", a, 0, 0)
    rows = [(0, 0, 1, c, r, float(a[r, c]), True) for r in range(16) for c in range(16)]
    packed = tiles.pack(spark.createDataFrame(rows, "src long, ord long, band int, x long, y long, v double, valid boolean"), 16)
    two = packed.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("block"), "band", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), "samples")
    with pytest.raises(Exception, match="there already"):
        two.repartition("block").sortWithinPartitions("block").write.format("geotiff").mode("append").options(path=str(tmp_path), edge=16, width=16, height=16, bands=1).save()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["b.tif"]
