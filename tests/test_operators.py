"""Operators on inputs whose answers are known by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import mercator, rects, text
from gridloom.functions.ranks import running
from gridloom.operators import benchmark, mosaic, planning, resample, scenes, stats, tiles

CELL = "src long, ord long, band int, x long, y long, v double, valid boolean"


def cells(spark, rows):
    return spark.createDataFrame(rows, CELL)


def grid(spark, a, src=0):
    a = np.asarray(a, float)
    return cells(spark, [(src, src, 1, x, y, float(a[y, x]), True) for y in range(a.shape[0]) for x in range(a.shape[1])])


def square(df):
    found = {(r.y, r.x): r.v for r in df.collect()}
    h, w = max(y for y, _ in found) + 1, max(x for _, x in found) + 1
    return [[found.get((y, x)) for x in range(w)] for y in range(h)]


def test_average_of_fractional_cells(spark):
    got = square(resample.average(grid(spark, np.arange(25).reshape(5, 5)), 2.5, 2.5))
    assert np.allclose(got, [[4.8, 7.2], [16.8, 19.2]], atol=1e-14)


def test_integer_average_rounds_halves_away_from_zero(spark):
    row = grid(spark, [[-1, -2, 8]])
    assert square(resample.average(row, 2.5, 2.5, integer=True))[0][0] == 0
    assert square(resample.average(row, 2.0, 1.0, integer=True)) == [[-2.0, 8.0]]
    assert square(resample.average(row, 2.0, 1.0, integer=True, low=0, high=5)) == [[0.0, 5.0]]


def test_average_error_bounds_another_order_of_summation(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(40, 40)) * 1e6
    got = {(r.y, r.x): (r.v, r.error) for r in resample.average(grid(spark, a), 4.0, 4.0, with_error=True).collect()}
    for (y, x), (v, error) in got.items():
        assert abs(v - math.fsum(a[4 * y : 4 * y + 4, 4 * x : 4 * x + 4].ravel()) / 16) <= error


def test_nearest_leaves_masked_centres_out(spark):
    a = [(0, 0, 1, x, y, float(5 * y + x), (x, y) != (2, 2)) for x in range(5) for y in range(5)]
    whole = resample.nearest(cells(spark, a).where("valid"), 5.0, 5.0, 5, 5)
    assert whole.count() == 0
    assert square(resample.nearest(cells(spark, a).where("valid"), 2.5, 2.5, 5, 5)) == [[6.0, 8.0], [16.0, 18.0]]


def test_posts_expand_to_the_east_on_ties(spark):
    posts = spark.createDataFrame([(0, 0, 1, x, 0, float(x), True, 2) for x in range(601)], CELL + ", factor int")
    got = {r.x: (r.v, r.rank) for r in resample.expand_posts(posts).collect() if r.x <= 1200}
    assert all(got[j][0] == min((j + 1) // 2, 600) for j in range(1201))
    assert all(got[j][1] == (0 if j % 2 == 0 else 2) for j in range(1201))


def test_native_posts_win_and_conflicts_are_found(spark):
    schema = CELL + ", rank int"
    posts = spark.createDataFrame([(0, 0, 1, 0, 0, 5.0, True, 2), (1, 1, 1, 0, 0, 6.0, True, 0), (2, 2, 1, 0, 0, 7.0, True, 0), (3, 3, 1, 1, 0, 8.0, True, 3), (4, 4, 1, 1, 0, 9.0, True, 3)], schema)
    assert {(r.x, r.v) for r in mosaic.ranked(posts).collect()} == {(0, 6.0), (1, 8.0)}
    assert [(r.x, r.low, r.high) for r in mosaic.native_conflicts(posts).collect()] == [(0, 6.0, 7.0)]


def test_mosaic_policies(spark):
    c = cells(spark, [(0, 0, 1, 0, 0, 1.0, True), (1, 1, 1, 0, 0, 2.0, True), (2, 2, 1, 0, 0, 3.0, False), (0, 0, 1, 1, 0, 4.0, True), (1, 1, 1, 1, 0, 4.0, True)])
    assert {(r.x, r.v) for r in mosaic.compose(c, "first").collect()} == {(0, 1.0), (1, 4.0)}
    assert {(r.x, r.v) for r in mosaic.compose(c, "last").collect()} == {(0, 2.0), (1, 4.0)}
    assert {(r.x, r.v, r.valid) for r in mosaic.overwrite(c).collect()} == {(0, 3.0, False), (1, 4.0, True)}
    with pytest.raises(Exception, match="conflicting samples"):
        mosaic.compose(c, "error").collect()
    assert mosaic.compose(c.where("x = 1"), "error").first().v == 4.0
    met = mosaic.overlap_conflicts(c).first()
    assert (met.pixels, met.valid_band_samples, met.conflicting_band_samples, met.example.first_value) == (2, 2, 1, 1.0)


def test_signed_zeros_and_nan_payloads_differ_as_stored(spark):
    bits = [int(np.float64(v).view(np.int64)) for v in (0.0, -0.0)]
    c = spark.createDataFrame([(i, i, 1, 0, 0, v, True, b) for i, (v, b) in enumerate(zip((0.0, -0.0), bits, strict=True))], CELL + ", bits long")
    assert mosaic.overlap_conflicts(c).first().conflicting_band_samples == 0
    assert mosaic.overlap_conflicts(c, exact_bits=True).first().conflicting_band_samples == 1


def test_verification_finds_a_changed_cell(spark):
    c = grid(spark, np.arange(16).reshape(4, 4)).select("band", "x", "y", "v")
    bad = c.withColumn("v", F.when(F.expr("x = 2 and y = 1"), 99.0).otherwise(F.col("v"))).where("not (x = 0 and y = 3)")
    r = mosaic.verify(c, bad).first()
    assert (r.expected, r.found, r.missing, r.unexpected, r.different) == (16, 15, 1, 0, 1)
    assert tuple(mosaic.first_difference(c, bad).first()) == (1, 1, 2, 6.0, 99.0)
    assert mosaic.first_difference(c, c).count() == 0


def test_statistics_by_exact_sums(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(1.125, 300, 5000)
    rows = [(0, 0, 1, i % 100, i // 100, float(x), i % 7 != 0) for i, x in enumerate(v)]
    r = stats.statistics(cells(spark, rows), ["band"]).first()
    good = [x for i, x in enumerate(v) if i % 7]
    mean = math.fsum(good) / len(good)
    assert r.mean == pytest.approx(mean, rel=1e-12) and r.stddev == pytest.approx(math.sqrt(math.fsum((x - mean) ** 2 for x in good) / len(good)), rel=1e-12)
    assert (r.minimum, r.maximum, r.valid_pixels, r.nodata_pixels) == (min(good), max(good), len(good), 5000 - len(good))
    packed = tiles.statistics(tiles.pack(cells(spark, rows), 128), ["band"]).first()
    assert packed.mean == pytest.approx(mean, rel=1e-12) and packed.stddev == pytest.approx(r.stddev, rel=1e-9) and packed.valid_pixels == len(good)
    nothing = stats.statistics(cells(spark, [(0, 0, 1, 0, 0, 1.0, False)]), ["band"])
    assert tuple(nothing.first())[1:6] == (None, None, None, None, 0)
    assert stats.statistics_differ(nothing, nothing, ["band"]).count() == 0
    assert stats.statistics_differ(nothing, stats.statistics(cells(spark, rows), ["band"]), ["band"]).count() == 1


def test_non_finite_samples_are_located(spark):
    c = cells(spark, [(0, 0, 1, 3, 2, float("nan"), True), (0, 0, 1, 1, 2, float("inf"), True), (0, 0, 1, 0, 0, float("nan"), False)])
    assert tuple(mosaic.non_finite(c).first()) == (1, 2, 1, 2)


def test_validity_rules(spark):
    r = spark.range(1).select(
        mosaic.valid_sample(F.lit(float("nan")), F.lit(float("nan"))).alias("a"), mosaic.valid_sample(F.lit(1.0), F.lit(float("nan"))).alias("b"), mosaic.valid_sample(F.lit(1.0), F.lit(None).cast("double")).alias("c"),
        mosaic.valid_tuple(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("d"), mosaic.valid_tuple(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("e"),
    ).first()
    assert tuple(r) == (False, True, True, True, False)


def test_unused_values(spark):
    c = cells(spark, [(0, 0, 1, i, 0, float(i), True) for i in range(256) if i != 77] + [(0, 0, 1, 0, 1, 77.0, False)])
    assert stats.smallest_unused(c, 0, 255).first().unused == 77
    assert stats.smallest_unused(c.where("v <> 5 or not valid"), 0, 70000).first().unused == 5
    full = cells(spark, [(0, 0, 1, i, 0, float(i), True) for i in range(256)])
    assert stats.smallest_unused(full, 0, 255).count() == 0
    assert [r.value for r in stats.suggest_nodata(c, [0.0, 77.0, -9999.0], 0, 255).orderBy("ordinal").collect()] == [77.0, -9999.0]
    assert [r.value for r in stats.suggest_nodata(c, [0.0, 1.0], 0, 255).collect()] == [77.0]


def test_quality(spark):
    pairs = spark.createDataFrame([(1, 10.0, 10.0, True), (1, 10.0, 13.0, True), (1, 0.0, 9.0, False)], "band int, a double, b double, valid boolean")
    r = stats.quality(pairs, ["band"]).first()
    assert (r.mae, r.max_error, r.differing, r.samples) == (1.5, 9.0, 2, 3)
    assert r.psnr == pytest.approx(10 * math.log10(255**2 / 4.5))
    same = stats.quality(pairs.withColumn("b", F.col("a")), ["band"]).first()
    assert same.psnr is None
    a = F.array(*[F.lit(float(v)) for v in (1, 5, 9, 200)])
    assert spark.range(1).select(stats.ssim(a, a).alias("s")).first().s == pytest.approx(1.0)


def test_overview_sizes(spark):
    def sizes(w, h, least):
        return [(s.w, s.h) for s in spark.range(1).select(rects.overview_sizes(F.lit(w).cast("long"), F.lit(h).cast("long"), least).alias("s")).first().s]

    assert sizes(1001, 777, 128) == [(501, 389), (251, 195), (126, 98)]
    assert sizes(1, 1025, 200) == [(1, 513), (1, 257), (1, 129)]
    assert sizes(512, 512, 512) == []


def test_pyramid_of_a_plane(spark):
    a = np.add.outer(0.25 * np.arange(8), 0.5 * np.arange(8))
    levels = resample.pyramid(grid(spark, a), 3)
    assert square(levels.where("level = 3")) == [[pytest.approx(a.mean())]]
    once = resample.halve(grid(spark, a), ["band"])
    assert np.allclose(square(once), a.reshape(4, 2, 4, 2).mean(axis=(1, 3)))
    packed = tiles.unpack(tiles.halve(tiles.pack(grid(spark, a), 4), 4), 4)
    assert np.allclose(square(packed), square(once))


def test_tile_mosaic_equals_cells(spark):
    r = random.Random(5)
    rows = list({(s, x, y): (s, s, 1, x, y, float(r.randint(0, 9)), r.random() < 0.7) for s in range(4) for x in range(20) for y in range(20) if r.random() < 0.6}.values())
    for policy in ("first", "last"):
        a = {(v.x, v.y): v.v for v in mosaic.compose(cells(spark, rows), policy).collect()}
        b = {(v.x, v.y): v.v for v in tiles.unpack(tiles.compose(tiles.pack(cells(spark, rows), 8), policy), 8).collect()}
        assert a == b


def test_tile_mosaic_shuffles_places_not_sources(spark, monkeypatch):
    """60 sources cover four places; tasks compose what they have first, however their sources' orders mix and however little they hold at once."""
    r = random.Random(8)
    rows = [(s, s * 7 % 60, 1, x, y, float(r.randint(0, 99)), r.random() < 0.7) for s in range(60) for x in range(8) for y in range(8) if r.random() < 0.5]
    packed = tiles.pack(cells(spark, rows), 4).localCheckpoint()
    for policy in ("first", "last"):
        want = {(v.x, v.y): v.v for v in mosaic.compose(cells(spark, rows), policy).collect()}
        for held in (tiles.HELD_BYTES, 1000):
            monkeypatch.setattr(tiles, "HELD_BYTES", held)
            before = {s.stageId() for s in _stages(spark)}
            made = tiles.compose(packed, policy).collect()
            sent = sum(s.shuffleWriteRecords() for s in _stages(spark) if s.stageId() not in before)
            assert {(v.x, v.y): v.v for v in tiles.unpack(spark.createDataFrame(made, tiles.TILE), 4).collect()} == want
            assert held == 1000 or sent <= 4 * packed.rdd.getNumPartitions()
        monkeypatch.undo()


def test_rectangles(spark):
    rows = [(0, 0, 0, 10, 10), (1, 5, 5, 10, 10), (2, 10, 0, 5, 5), (3, 40, 40, 0, 5), (4, 0, 0, 10, 10)]
    df = spark.createDataFrame(rows, "ord long, x long, y long, w long, h long")
    met = {(r.a, r.b): (r.x, r.y, r.w, r.h) for r in planning.overlap_pairs(df, key_size=4).collect()}
    assert met == {(0, 1): (5, 5, 5, 5), (0, 4): (0, 0, 10, 10), (1, 4): (5, 5, 5, 5)}
    assert planning.union_area(df.withColumn("k", F.lit(1)), ["k"]).first().area == 100 + 100 - 25 + 25
    r = random.Random(2)
    many = [(i, r.randint(0, 30), r.randint(0, 30), r.randint(1, 9), r.randint(1, 9)) for i in range(60)]
    want = len({(x + i, y + j) for _, x, y, w, h in many for i in range(w) for j in range(h)})
    assert planning.union_area(spark.createDataFrame(many, df.schema).withColumn("k", F.lit(1)), ["k"]).first().area == want


def test_regions_cover_all_sources(spark):
    r = random.Random(4)
    many = [(r.randint(0, 200), r.randint(0, 200), r.randint(5, 40), r.randint(5, 40)) for _ in range(30)]
    sources = spark.createDataFrame([(i, *m) for i, m in enumerate(many)], "ord long, x long, y long, w long, h long")
    out = planning.regions(sources, 2000)
    assert all(x.w * x.h <= 2000 for x in out.collect()) and [x.ord for x in out.orderBy("y", "x").collect()] == list(range(out.count()))
    # far apart and thin: empty space between is no output, and one output may be longer than a cell of its area
    sparse = spark.createDataFrame([(0, 0, 0, 3, 3), (1, 9000, 9000, 3, 3), (2, 40, 0, 300, 1)], sources.schema)
    assert sorted((x.x, x.y, x.w, x.h) for x in planning.regions(sparse, 2000).collect()) == [(0, 0, 340, 3), (9000, 9000, 3, 3)]
    assert planning.regions(sources.limit(0), 2000).count() == 0
    assert planning.overlap_pairs(out).count() == 0
    assert planning.coverage(sources, out).where("area <> covered").count() == 0


def test_regions_are_the_largest_cells_that_fit(spark, monkeypatch):
    r = random.Random(6)
    many = [(r.choice([0, 0, 5000, 70000]) + r.randint(0, 300), r.choice([0, 0, 9000]) + r.randint(0, 300), r.randint(1, 30), r.randint(1, 30)) for _ in range(100)]
    sources = spark.createDataFrame([(i, *m) for i, m in enumerate(many)], "ord long, x long, y long, w long, h long")
    x0, y0 = min(m[0] for m in many), min(m[1] for m in many)
    side = max(max(m[0] + m[2] for m in many) - x0, max(m[1] + m[3] for m in many) - y0)
    for target in (1, 2000, 10**6):
        edge = max(1, math.isqrt(target) // 8)
        levels, parts = range(2 * max(1, (-(-side // edge) - 1).bit_length()) + 1), {}
        cell = lambda n, kx, ky: (n, kx >> (n + 1) // 2, ky >> n // 2)
        for x, y, w, h in ((x - x0, y - y0, w, h) for x, y, w, h in many):
            for kx in range(x // edge, (x + w - 1) // edge + 1):
                for ky in range(y // edge, (y + h - 1) // edge + 1):
                    p = max(x, kx * edge), max(y, ky * edge), min(x + w, kx * edge + edge), min(y + h, ky * edge + edge)
                    for n in levels:
                        o = parts.get(at := cell(n, kx, ky), p)
                        parts[at] = min(p[0], o[0]), min(p[1], o[1]), max(p[2], o[2]), max(p[3], o[3])
        fits = {at for at, p in parts.items() if at[0] == 0 or (p[2] - p[0]) * (p[3] - p[1]) <= target}
        chosen = {parts[max(at for n in levels if (at := cell(n, *k[1:])) in fits)] for k in parts if k[0] == 0}
        want = sorted((b + y0, a + x0, c - a, d - b) for a, b, c, d in chosen)
        for most in (12, 4):
            monkeypatch.setattr(planning, "GROUP_LEVELS", most)
            got = sorted((v.ord, v.y, v.x, v.w, v.h) for v in planning.regions(sources, target).collect())
            assert got == [(i, *v) for i, v in enumerate(want)]


def test_regions_shuffle_few_rows_a_square(spark):
    """Each square shuffled for each level, and joined back to it, were 40 rows a square and more."""
    sources = spark.createDataFrame([(i, i % 64 * 9, i // 64 * 9, 7, 7) for i in range(4096)], "ord long, x long, y long, w long, h long")
    before = {s.stageId() for s in _stages(spark)}
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        planning.regions(sources, 2000).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    rows = sum(s.shuffleWriteRecords() for s in _stages(spark) if s.stageId() not in before)
    squares = len({(kx, ky) for i in range(4096) for kx in range(i % 64 * 9 // 5, (i % 64 * 9 + 6) // 5 + 1) for ky in range(i // 64 * 9 // 5, (i // 64 * 9 + 6) // 5 + 1)})
    assert rows < 8 * squares


def _stages(spark):
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def test_block_names_and_windows(spark):
    t = spark.createDataFrame([("a", 20, 30), ("b", 21, 30), ("c", -180, -90)], "path string, west int, south int")
    got = {r.block: (r.west, r.south, r.east, r.north, r.w, r.h, r.tiles, r.eligible) for r in planning.tile_blocks(t, 10, 2, 3600).collect()}
    assert got["BLOCK_N30E020_N39E029"] == (20, 30, 30, 40, 36001, 36001, 2, True)
    assert got["BLOCK_S90W180_S81W171"][6:] == (1, False)


def test_tile_identity_and_projection(spark):
    for z, x, y in ((0, 0, 0), (9, 301, 206), (14, 9789, 6580)):
        box = mercator.tile_bbox(F.lit(z), F.lit(x), F.lit(y))
        got = spark.range(1).select(box.alias("b")).select(mercator.view_tiles(F.lit(z), F.col("b.west"), F.col("b.south"), F.col("b.east"), F.col("b.north")).alias("t")).first().t
        assert [tuple(t) for t in got] == [(z, x, y)]
    r = spark.range(1).select(mercator.forward(F.lit(180.0), F.lit(0.0)).alias("p")).first().p
    assert (r.x, round(r.y, 6)) == (mercator.HALF, 0.0)


def test_percentiles(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4, 100)], "k int, seconds double")
    r = benchmark.latencies(rows, ["k"]).first()
    assert r.p50 == 3 and r.p99 > 95
    assert benchmark.latencies(rows.limit(0), []).first().p50 is None


def test_job_matrix_is_stable(spark):
    v, p = spark.createDataFrame([("a",), ("b",)], "variant string"), spark.createDataFrame([("s",)], "profile string")
    jobs = benchmark.job_matrix(v, p, ["hit", "miss"], 4, [1, 10])
    assert jobs.count() == 32 and jobs.select("id").distinct().count() == 32
    assert {r.id for r in jobs.collect()} == {r.id for r in benchmark.job_matrix(v, p, ["hit", "miss"], 4, [1, 10]).collect()}


def test_fast_failures_lose(spark):
    need = [("miss", 0)]
    runs = spark.createDataFrame([("fast", True, "miss", 0, True, 1.0, 0.01), ("sound", True, "miss", 0, True, 0.0, 1.0), ("part", False, "wms", 0, True, 0.0, 0.1)], "variant string, lossless boolean, scenario string, repetition int, valid boolean, error_fraction double, p95 double")
    assert [(r.lossless, r.variant) for r in benchmark.shortlist(runs, need).collect()] == [(True, "sound")]


def test_qualification_needs_the_whole_matrix(spark):
    schema = "variant string, profile string, cpus int, memory_gib int, scenario string, repetition int, valid boolean, p95 double, error_fraction double, cpu_p95 double, memory_peak double"
    good = [("v", p, c, 4, s, 0, True, 1.0, 0.0, 0.5, 0.5) for p, c in (("big", 8), ("small", 2)) for s in ("hit", "miss")]
    rows = [*good, ("v", "tiny", 1, 4, "hit", 0, True, 3.0, 0.0, 0.9, None)]
    made = benchmark.qualify(spark.createDataFrame(rows, schema), [("hit", 0), ("miss", 0)])
    reasons = {r.profile: list(r.reasons) for r in made.collect()}
    assert reasons["big"] == [] and reasons["tiny"] == ["CPU headroom", "incomplete scenario/repetition matrix", "memory headroom", "view latency target"]
    assert [(r.variant, r.profile) for r in benchmark.smallest_profiles(made).collect()] == [("v", "small")]


def test_traces_replay(spark):
    spots, extent = [("a", 0.0, 5e6), ("b", 1e6, 6e6)], (-1e6, 4e6, 2e6, 7e6)
    make = lambda seed: benchmark.make_traces(spark.range(5).withColumnRenamed("id", "user"), spots, (6, 10), 40, extent, seed=seed)
    rows = sorted(map(tuple, make(7).collect()))
    assert rows == sorted(map(tuple, make(7).repartition(3).collect())) and rows != sorted(map(tuple, make(8).collect()))
    assert len(rows) == 200 and {r[2] for r in rows} == {"pan", "zoom", "revisit", "relocate"}
    half = 20037508.342789244
    for before, r in zip([None, *rows], rows, strict=False):
        metre = 2 * half / 256 / 2 ** r[3]
        assert 6 <= r[3] <= 10 and extent[0] + 640 * metre - 1e-6 <= r[4] <= extent[2] - 640 * metre + 1e-6 and 0.5 <= r[7] < 2.5
        if before and before[0] == r[0]:
            assert r[2] != "zoom" or abs(r[3] - before[3]) <= 1
            seen = [(x[3], x[4], x[5]) for x in rows if x[0] == r[0] and r[1] - 8 <= x[1] < r[1]]
            assert r[2] != "revisit" or (r[3], r[4], r[5]) in seen
    dealt = benchmark.round_robin(spark.range(100), ["id"], 7)
    assert {r.id: r.user for r in dealt.collect()} == {i: i % 7 for i in range(100)}


def test_running_sums_over_ranges(spark):
    rows = spark.createDataFrame([(i * 7919 % 101, i) for i in range(101)], "k long, v long").repartition(5)
    got = sorted((r.k, r.v, r.place, r.before) for r in running(rows, ["k"], add="v").collect())
    assert [r[2] for r in got] == list(range(101)) and [r[3] for r in got] == [sum(x[1] for x in got[:i]) for i in range(101)]
    assert running(rows.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize(("block", "zone"), [(2000, 8_000_000), (2, 8_000_000), (3, 40)])
def test_overlaps_of_blocks_by_brute_force(spark, monkeypatch, block, zone):
    monkeypatch.setattr(mosaic, "BLOCK", block)
    monkeypatch.setattr(mosaic, "ZONE", zone)
    r = random.Random(3)
    values = [0.0, 1.0, 2.0, float("nan"), None]
    rows = {(f"s{r.randint(0, 6)}", r.choice((1, 2, 70, 255)), r.randint(0, 40), r.randint(0, 2)): r.choice(values) for _ in range(600)}
    cells = spark.createDataFrame([(s, 1, b, x, y, v, True) for (s, b, x, y), v in rows.items()], "src string, ord long, band int, x long, y long, v double, valid boolean")
    want = {}
    for (s, b, x, y), v in sorted(rows.items(), key=lambda e: (e[0][3], e[0][2], e[0][1])):
        for t in {k[0] for k in rows}:
            if s < t and (t, b, x, y) in rows:
                w = rows[t, b, x, y]
                pixels, n, off, first = want.get((s, t), (set(), 0, 0, None))
                differ = v is not None and w is not None and str(v) != str(w)
                want[s, t] = pixels | {(x, y)}, n + 1, off + differ, first or ((y, x, b, str(v), str(w)) if differ else None)
    got = {tuple(m)[:2]: (*tuple(m)[2:5], m.example and (*m.example[:3], *map(str, m.example[3:]))) for m in mosaic.overlap_conflicts(cells).collect()}
    assert got == {k: (len(p), n, off, first) for k, (p, n, off, first) in want.items()}


@pytest.mark.parametrize("exact_bits", [False, True])
@pytest.mark.parametrize(("piece", "at_once"), [(2_000_000, 2_000_000), (2_000_000, 5), (20, 7), (1, 100)])
def test_overlaps_of_many_blocks(spark, monkeypatch, piece, at_once, exact_bits):
    r = random.Random(piece + at_once)
    rows = {(f"s{r.randint(0, 12)}", r.choice((1, 2, 70, 255)), r.randint(0, 30), r.randint(0, 2)): (r.choice([0.0, -0.0, 2.0, float("nan"), 3.0 if exact_bits else None]), r.choice([2**60, 2**60 + 1, None])) for _ in range(900)}
    made = spark.createDataFrame([(s, 1, b, x, y, *v, True) for (s, b, x, y), v in rows.items()], "src string, ord long, band int, x long, y long, v double, bits long, valid boolean")
    few = sorted(map(str, mosaic.overlap_conflicts(made, exact_bits).collect()))
    monkeypatch.setattr(mosaic, "BLOCK", 2)
    monkeypatch.setattr(mosaic, "PIECE", piece)
    monkeypatch.setattr(mosaic, "AT_ONCE", at_once)
    assert sorted(map(str, mosaic.overlap_conflicts(made, exact_bits).collect())) == few and len(few) == 78


def test_samples_are_not_copied_to_many_blocks(spark, monkeypatch):
    made = cells(spark, [(s, s, 1, x, 0, float(s), True) for s in range(60) for x in range(40)])
    monkeypatch.setattr(mosaic, "BLOCK", 1)
    before = {s.stageId() for s in _stages(spark)}
    assert mosaic.overlap_conflicts(made).count() == 60 * 59 // 2
    # 60 blocks: a copy of each sample for each of them is 144,000 rows
    assert 0 < sum(s.shuffleWriteRecords() for s in _stages(spark) if s.stageId() not in before) <= 5 * 2400


def test_bootstrap_is_reproducible(spark):
    runs = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 1.0), ("c", None)], "variant string, p95 double")
    got = {r.variant: (r.n, r.low, r.high) for r in benchmark.bootstrap(runs, "variant", "p95").collect()}
    assert got["b"] == (1, None, None) and got["c"] == (0, None, None) and 1 < got["a"][1] < 2.5 < got["a"][2] < 4
    # the mean of four draws from 1 to 4 has a standard deviation of 0.559
    assert abs(got["a"][1] - (2.5 - 1.96 * 0.559)) < 0.15 and abs(got["a"][2] - (2.5 + 1.96 * 0.559)) < 0.15


def test_bootstrap_of_rows_and_of_joins(spark, monkeypatch):
    runs = spark.createDataFrame([(k, i * 7919 % 101 / 8.0) for k, n in (("a", 40), ("b", 7), ("c", 2), (None, 9)) for i in range(n)] + [("d", None)], "k string, v double").repartition(3)
    look = lambda: {r.k: tuple(x if x is None else round(x, 9) for x in tuple(r)[1:]) for r in benchmark.bootstrap(runs, "k", "v", resamples=25).collect()}
    whole = look()
    assert set(whole) == {"a", "b", "c", "d", None} and whole["a"][0] == 40 and whole["d"] == (0, None, None)
    for held in (8, 1):
        monkeypatch.setattr(benchmark, "HELD", held)
        assert look() == whole
    plan = benchmark._held_means(runs.select(F.col("k").alias("key"), "v"), 25, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # no ranked value is sent to the driver to be broadcast


def test_scenes_of_one_ring_are_one_row_of_the_cover(spark, monkeypatch):
    sizes, kept = [], scenes.written
    monkeypatch.setattr(scenes, "written", lambda df: (made := kept(df), sizes.append(made.count()))[0])
    rows = [(f"s{i:03d}", float(i * 7 % 5), float(i % 3 * 4), 0.0, float(i % 3 * 4 + 5), 5.0) for i in range(90)]
    got = scenes.greedy_cover(spark.createDataFrame(rows, "id string, cloud_cover double, west double, south double, east double, north double"), (0.0, 0.0, 13.0, 5.0)).collect()
    # of each of three places the first of those without cloud
    assert sizes == [3] and [(r.id, r.gain) for r in got] == [("s000", 25.0), ("s005", 25.0), ("s010", 15.0)]


def test_a_trace_asks_for_each_hash_once(spark):
    made = benchmark.make_traces(spark.range(3).select(F.col("id").alias("user")), [("a", 0.0, 0.0)], (4, 12), 5, (-1e6, -1e6, 1e6, 1e6))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 20 and made.count() == 15


def test_paths_are_taken_apart_once(spark):
    rows = spark.createDataFrame([("/a/b/c.tif", "/a/d"), ("/a/c.tif", "/a/b/../."), ("s3://x/a/c", "/a"), ("/", "/a")], "path string, folder string")
    made = rows.select(text.relative_path(F.col("path"), F.col("folder")).alias("p"))
    assert [r.p for r in made.collect()] == ["../b/c.tif", "../../c.tif", "s3://x/a/c", ".."]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2


def test_spread_rows_are_as_many_tasks_as_a_shuffle(spark):
    from gridloom.functions.shared import spread
    from gridloom.plans import formats, queries, rasters

    assert formats and rasters and spread(spark.range(50).coalesce(1)).rdd.getNumPartitions() == 4
    for name in ("icon_rules", "relative_paths", "trace_views"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_scenes_by_brute_force(spark):
    r = random.Random(6)
    rows = [(f"s{i:02d}", float(r.randint(0, 3)), (w := r.randint(-2, 9)), (s := r.randint(-2, 9)), w + r.randint(1, 5), s + r.randint(1, 5), r.random() < 0.5, 1_700_000_000 + r.randint(0, 9)) for i in range(40)]
    inside = {i: {(x, y) for x in range(max(0, a[2]), min(10, a[4])) for y in range(max(0, a[3]), min(10, a[5]))} for i, a in enumerate(rows)}
    open_, chosen, left = {(x, y) for x in range(10) for y in range(10)}, [], {i for i in inside if inside[i]}
    for first in (True, False):
        while len(open_) > 100 * 0.0001 and (rest := {i for i in left if rows[i][6] or not first}):
            gain = {i: len(inside[i] & open_) for i in rest}
            top = max(gain.values())
            if top < 100 * (1e-5 if first else 1e-6):
                break
            i = min((-gain[i], rows[i][1], rows[i][0], i) for i in rest)[-1] if first else min((rows[i][1], -rows[i][7], rows[i][0], i) for i in rest if gain[i] >= top * 0.99)[-1]
            chosen.append((rows[i][0], float(gain[i])))
            open_ -= inside[i]
            left.remove(i)
    p = spark.createDataFrame(rows, "id string, cloud_cover double, west int, south int, east int, north int, best boolean, acquired long")
    p = p.withColumn("acquired", F.timestamp_seconds("acquired"))
    got = [(x.id, x.gain) for x in scenes.greedy_cover(p, (0.0, 0.0, 10.0, 10.0)).orderBy("step").collect()]
    assert got == chosen and len(got) > 5
    with pytest.raises(scenes.Uncovered):
        scenes.greedy_cover(p.limit(1), (0.0, 0.0, 10.0, 10.0), required=0.995)


def test_complementary_scenes(spark):
    rows = [("a", "t1", 5.0, 0.0, 0.0, 6.0, 10.0), ("b", "t2", 6.0, 6.0, 0.0, 10.0, 10.0), ("sliver", "t1", 0.0, 0.0, 0.0, 0.1, 10.0)]
    p = spark.createDataFrame(rows, "id string, tile_id string, cloud_cover double, west double, south double, east double, north double")
    assert [r.id for r in scenes.greedy_cover(p, (0.0, 0.0, 10.0, 10.0)).orderBy("step").collect()] == ["a", "b"]
    q = p.withColumn("area", (F.col("east") - F.col("west")) * 10).withColumn("online", F.lit(True)).withColumn("acquired", F.lit("2026-01-01").cast("timestamp"))
    assert {(r.tile_id, r.id) for r in scenes.best_per_tile(q).collect()} == {("t1", "a"), ("t2", "b")}


def test_text_functions(spark):
    def one(c):
        return spark.range(1).select(c.alias("c")).first().c

    assert one(text.size_bytes(F.lit("25GB"))) == 25 * 10**9 and one(text.size_bytes(F.lit("25GiB"))) == 25 * 2**30
    assert one(text.size_bytes(F.lit("ten"))) is None and one(text.size_bytes(F.lit("5XB"))) is None
    assert one(text.duration(F.lit(3723))) == "01:02:03"
    assert one(text.portable_name(F.lit("out_1.tif"))) and not one(text.portable_name(F.lit("con.tif")))
    assert one(text.number_map(F.lit("usage_usec 12\nbad x\nfile 3"))) == {"usage_usec": 12, "file": 3}
    assert one(text.fingerprint(F.lit('{"b": 1, "a": [2]}'))) == one(text.fingerprint(F.lit('{"a":[2],"b":1}')))
    png = bytes.fromhex("89504e470d0a1a0a0000000d49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    assert tuple(one(text.png_size(F.lit(png)))) == (640, 480)
    assert one(text.png_size(F.lit(b"<?xml"))) is None
    assert one(text.semantic_metadata(F.create_map(F.lit("STATISTICS_MEAN"), F.lit("1"), F.lit("unit"), F.lit("m")))) == {"unit": "m"}
    assert one(rects.coordinate(F.lit(-7), F.lit(12))) == "S07E012"


def test_telemetry_steps_without_time_are_left_out(spark):
    schema = "k int, phase string, monotonic double, usage_usec double, throttled_usec double, memory_bytes long, rss_bytes long, heap_bytes long, file_bytes long, cache_bytes long, available_bytes long, io_bytes long, gc_seconds double"
    rows = [(1, "measurement", float(t), u * 1e6, 0.0, 2**30, 1, 1, 1, 1, 5 - i, 10 * i, 0.5 * i) for i, (t, u) in enumerate(((0, 0), (1, 1), (1, 9), (2, 10)))]
    r = benchmark.telemetry_summary(spark.createDataFrame([*rows, (1, "warmup", -1.0, 0.0, 0.0, 2**40, 1, 1, 1, 1, 1, 1, 0.0)], schema), ["k"], 2.0, 4.0).first()
    assert r.samples == 4 and r.cpu_utilization_p95 == pytest.approx(0.5) and r.memory_utilization_peak == 0.25 and r.io_delta == 30 and r.complete


def test_reuse_forgets_failed_views(spark):
    v = spark.createDataFrame([(1, 0, True, [1, 2]), (1, 1, False, [2, 3]), (1, 2, True, [3, 4])], "user int, view int, ok boolean, tiles array<int>")
    got = {r.view: (list(r.needed), list(r.reused)) for r in benchmark.tile_reuse(v).collect()}
    assert got == {0: ([1, 2], []), 1: ([3], [2]), 2: ([3, 4], [])}


def test_value_keys_and_unused_values(spark):
    numbers = [0.0, -0.0, 1.5, -1.5, 5e-324, -5e-324, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(numbers)], "i int, v double").orderBy("i")
    for kind, dtype, bits in (("float64", np.float64, np.int64), ("float32", np.float32, np.uint32)):
        got = [r.k for r in df.select(stats.value_key(F.col("v"), kind).alias("k")).collect()]
        for v, k in zip(numbers, got, strict=True):
            stored = None if v is None or v != v else np.array([v], dtype)
            assert k == (None if stored is None else 0 if stored[0] == 0 else int(stored.view(bits)[0]))
    one = lambda values, kind: [r.value for r in stats.unused_value(spark.createDataFrame([(v, ok) for v, ok in values], "v double, valid boolean"), kind).collect()]
    step = 2.0**-149
    assert one([], "float32") == [0.0] and one([(-0.0, True), (float("nan"), True)], "float32") == [step]
    assert one([(0.0, True), (step, True), (2 * step, False), (3 * step, True), (-step, True)], "float32") == [2 * step]
    assert one([(float(k), True) for k in range(255)], "uint8") == [255.0] and one([(float(k), True) for k in range(256)], "uint8") == []
    assert one([(-32768.0, True)], "int16") == [-32767.0] and one([(5e-324 * k, True) for k in range(70_000)], "float64") == [5e-324 * 70_000]
