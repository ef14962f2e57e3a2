"""Coordinate systems and polygons against published values, round trips and an independent area."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import polygons, projection, text
from gridloom.operators import scenes

#: The British National Grid and a place in it, as the register's guidance gives them to the centimetre.
GRID = projection.Transverse(-2.0, 49.0, 0.9996013, 400_000.0, -100_000.0, 6377563.396, 1 / 299.32496)
PUBLISHED = (0.5, 50.5, 577274.99, 69740.50)


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


def test_published_values(spark):
    lon, lat, x, y = PUBLISHED
    got = one(spark, projection.to_grid(F.lit(lon), F.lit(lat), GRID))
    assert got.x == pytest.approx(x, abs=0.006) and got.y == pytest.approx(y, abs=0.006)
    back = one(spark, projection.from_grid(F.lit(x), F.lit(y), GRID))
    assert back.x == pytest.approx(lon, abs=1e-7) and back.y == pytest.approx(lat, abs=1e-7)
    # the quarter of WGS 84's meridian is 10001965.7293 m
    pole = one(spark, projection.to_grid(F.lit(33.0), F.lit(89.9999999999), projection.utm(32636)))
    assert pole.x == pytest.approx(500_000, abs=1e-4) and pole.y == pytest.approx(0.9996 * 10001965.7293, abs=1e-3)
    assert tuple(one(spark, projection.to_grid(F.lit(33.0), F.lit(0.0), projection.utm(32636)))) == (500_000.0, 0.0)
    assert one(spark, projection.to_grid(F.lit(33.0), F.lit(0.0), projection.utm(32736))).y == 10_000_000.0


def test_there_and_back_within_a_tenth_of_a_millimetre(spark):
    r = random.Random(1)
    rows = [(r.uniform(24, 42), r.uniform(-80, 84)) for _ in range(500)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    utm = projection.utm(32636)
    at = df.select("lon", "lat", projection.to_grid(F.col("lon"), F.col("lat"), utm).alias("g"))
    far = at.select("g", projection.from_grid(F.col("g.x"), F.col("g.y"), utm).alias("d"), "lon", "lat")
    for x in far.collect():
        assert math.hypot((x.d.x - x.lon) * math.cos(math.radians(x.lat)), x.d.y - x.lat) * 111_320 < 1e-4
    for code in (32600, 32661, 32801, 4326):
        with pytest.raises(ValueError):
            projection.utm(code)


def test_rectangles_in_another_system(spark):
    box = [F.lit(v) for v in (300000.0, 3000000.0, 340000.0, 3050000.0)]
    ring = one(spark, projection.densified(*box))
    assert len(ring) == 84 and tuple(ring[0]) == (300000.0, 3000000.0) and tuple(ring[20]) == tuple(ring[21]) == (340000.0, 3000000.0) and tuple(ring[-1]) == (300000.0, 3000000.0)
    assert one(spark, projection.ring_area(projection.densified(*box))) == 40000.0 * 50000.0
    utm = projection.utm(32636)
    inner = one(spark, projection.inscribed(*box, utm))
    corners = [one(spark, projection.from_grid(F.lit(x), F.lit(y), utm)) for x in (300000.0, 340000.0) for y in (3000000.0, 3050000.0)]
    xs = sorted(c.x / 180 * math.pi * 6378137 for c in corners)
    ys = sorted(math.log(math.tan(math.pi / 4 + math.radians(c.y) / 2)) * 6378137 for c in corners)
    assert (inner.west, inner.east) == pytest.approx((xs[1], xs[2]), abs=1e-6) and (inner.south, inner.north) == pytest.approx((ys[1], ys[2]), abs=1e-6)


def slab_area(rings, inside):
    """The area where `inside` holds of which rings hold a place: between all corners and crossings, trapezoids in slabs."""
    edges = [(i, a, b) for i, r in enumerate(rings) for a, b in zip(r, r[1:] + r[:1], strict=True)]
    cuts = {p[0] for r in rings for p in r}
    for k, (_, a, b) in enumerate(edges):
        for _, c, d in edges[k + 1 :]:
            den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if den:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
                if 0 <= t <= 1:
                    cuts.add(a[0] + t * (b[0] - a[0]))
    total, cuts = 0.0, sorted(cuts)
    for x0, x1 in zip(cuts, cuts[1:], strict=False):
        mid = (x0 + x1) / 2
        if x1 - x0 < 1e-12:
            continue
        at = sorted((a[1] + (b[1] - a[1]) * (mid - a[0]) / (b[0] - a[0]), i) for i, a, b in edges if min(a[0], b[0]) < mid < max(a[0], b[0]))
        have = [False] * len(rings)
        for (y, i), (y2, _) in zip(at, at[1:], strict=False):
            have[i] = not have[i]
            if inside(have):
                total += (y2 - y) * (x1 - x0)
    return total


BENT = [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (3.0, 1.5), (0.0, 6.0)]


@pytest.mark.parametrize("ring", [BENT, BENT[::-1], [*BENT, BENT[0]], [(0.0, 0.0), (4.0, 0.0), (4.0, 0.0), (2.0, 3.0)], [(0.0, 0.0), (2.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]])
def test_parts_have_the_area_of_the_whole(ring):
    parts = polygons.convex_parts(ring)
    assert sum(polygons.area(p) for p in parts) == pytest.approx(abs(polygons.area(ring)))
    assert all(polygons.side(p[i - 2], p[i - 1], p[i]) >= 0 for p in parts for i in range(len(p)))


def test_odd_rings():
    assert [polygons.convex_parts(r) for r in ([], [(0.0, 0.0)], [(0.0, 0.0), (1.0, 1.0)], [(1.0, 1.0)] * 5, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)])] == [[]] * 5
    star = [(math.cos(4 * math.pi * k / 5), math.sin(4 * math.pi * k / 5)) for k in range(5)]
    assert polygons.convex_parts(star) != [star]


def test_what_polygons_share_and_leave():
    r = random.Random(3)
    for _ in range(30):
        rings = [[(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(3)] for _ in range(3)]
        a, *others = [polygons.convex_parts(x) for x in rings]
        pieces = a
        for o in others:
            pieces = polygons.without(pieces, o)
        left = sum(abs(polygons.area(p)) for p in pieces)
        assert left == pytest.approx(slab_area(rings, lambda h: h[0] and not h[1] and not h[2]), abs=1e-9)
        met = polygons.shared(a, [polygons.bounds(p) for p in a], others[0])
        assert met == pytest.approx(slab_area(rings, lambda h: h[0] and h[1]), abs=1e-9)


@pytest.mark.parametrize("ahead", [256, 3])
def test_cover_of_polygons(spark, monkeypatch, ahead):
    monkeypatch.setattr(scenes, "AHEAD", ahead)
    r = random.Random(7)
    aoi, rows = BENT, []
    for i in range(40):
        x, y, s = r.uniform(-1, 5), r.uniform(-1, 5), r.uniform(0.8, 2.5)
        rows.append((f"s{i:02d}", float(i % 4), [(x, y), (x + s, y + 0.3), (x + s * 0.8, y + s), (x, y + s * 1.1)], i % 3 > 0, i))
    whole = abs(polygons.area(aoi))
    taken, want, covered = [], [], 0.0
    for best, stop in ((True, 1e-5), (False, 1e-6)):
        while covered < whole * 0.9999:
            rest = [x for x in rows if (x[3] or not best) and x[0] not in [w[0] for w in want]]
            gains = [(slab_area([aoi, x[2], *taken], lambda h: h[0] and h[1] and not any(h[2:])), x) for x in rest]
            most = max((g for g, _ in gains), default=0.0)
            if most < whole * stop:
                break
            gain, pick = min(gains, key=lambda g: (-round(g[0] / whole, 9), g[1][1], g[1][0])) if best else min((g for g in gains if g[0] >= most * 0.99), key=lambda g: (g[1][1], -g[1][4], g[1][0]))
            taken.append(pick[2])
            want.append((pick[0], gain))
            covered += gain
    df = spark.createDataFrame(rows, "id string, cloud_cover double, ring array<struct<x double, y double>>, best boolean, t long").withColumn("acquired", F.timestamp_seconds("t"))
    got = [(x.id, x.gain) for x in scenes.greedy_cover(df, aoi).orderBy("step").collect()]
    assert [g[0] for g in got] == [w[0] for w in want] and len(want) > 8
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)
    areas = {x.id: x.area for x in scenes.inside(df, aoi).collect()}
    assert areas == pytest.approx({x[0]: slab_area([aoi, x[2]], all) for x in rows}, abs=1e-9)


def test_outputs(spark):
    ok = lambda v, t: one(spark, text.output_nodata(F.lit(v), F.lit(t)))
    assert [ok("255", "uint8"), ok("-9999", "int16"), ok("1e2", "uint8"), ok("0.5", "float32"), ok("-inf", "float32")] == [255.0, -9999.0, 100.0, 0.5, float("-inf")]
    assert math.isnan(ok("NaN", "float64"))
    assert [ok(*x) for x in (("256", "uint8"), ("0.5", "int16"), ("0.1", "float32"), ("NaN", "int32"), ("x", "float64"), ("", "uint8"), ("1", "text"))] == [None] * 7
    fill = lambda v: one(spark, text.byte_fill(F.lit(v)))
    assert [fill(v) for v in ("0", "255", "7.0", "-1", "256", "7.5", "NaN", None)] == [0, 255, 7, None, None, None, None, None]
    seen = lambda p, f: one(spark, text.relative_path(F.lit(p), F.lit(f)))
    assert seen("/a/b/c.tif", "/a/x/y") == "../../b/c.tif" and seen("/a/b/c.tif", "/a/b/") == "c.tif" and seen("/a/b", "/a/b/c/d") == "../.."
    assert seen("s3://one/a/c.tif", "s3://one/b") == "../a/c.tif" and seen("s3://one/a/c.tif", "s3://two/b") == "s3://one/a/c.tif" and seen("C:\\a\\c.tif", "C:/b") == "../a/c.tif" and seen("D:/a", "C:/a") == "D:/a"
