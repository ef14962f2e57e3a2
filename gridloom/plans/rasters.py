"""Registered queries over coordinate systems, footprints, masks, resumed jobs and values that outputs can hold, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions import codecs, projection, text
from gridloom.functions.shared import scratch, spread
from gridloom.operators import planning, scenes, tiles
from gridloom.plans import views
from gridloom.plans.queries import _last, query, rounded
from gridloom.sources import geotiff, vrt

_ZERO = projection.Transverse(0.0)
_N = _ZERO.n
_E = math.sqrt(_ZERO.flattening * (2 - _ZERO.flattening))


def _series(terms: list[float], f: str, g: str, a: str, b: str) -> str:
    return " + ".join(f"{t!r} * {f}({2 * j} * {a}) * {g}({2 * j} * {b})" for j, t in enumerate(terms, 1))


#: The zone of a place; rows (id, zone, x, y) of its metres.
GRID = f"""{views.PLACES}, zoned as (select id, lon, lat, cast(floor((lon + 180) / 6) + 1 as integer) zone, sin(radians(lat)) s, radians(lon - (6 * (floor((lon + 180) / 6) + 1) - 183)) w from places),
conformal as (select *, sinh(atanh(s) - {_E!r} * atanh({_E!r} * s)) t from zoned),
sphere as (select *, atan2(t, cos(w)) xi, atanh(sin(w) / sqrt(1 + t * t)) eta from conformal),
grid as (select id, zone, 500000 + {_ZERO.radius!r} * (eta + {_series(projection.forward_terms(_N), "cos", "sinh", "xi", "eta")}) x,
  case when lat < 0 then 10000000 else 0 end + {_ZERO.radius!r} * (xi + {_series(projection.forward_terms(_N), "sin", "cosh", "xi", "eta")}) y from sphere)"""


def _inverse(source: str) -> str:
    """Degrees of rows (id, i, x, y) in zone 36 north."""
    return f"""turned as (select *, y / {_ZERO.radius!r} u, (x - 500000) / {_ZERO.radius!r} v from {source}),
flat as (select *, u - ({_series(projection.inverse_terms(_N), "sin", "cosh", "u", "v")}) xi, v - ({_series(projection.inverse_terms(_N), "cos", "sinh", "u", "v")}) eta from turned),
chi as (select *, asin(sin(xi) / cosh(eta)) c from flat),
degrees_ as (select id, i, degrees(atan2(sinh(eta), cos(xi))) + 33 lon,
  degrees(c + {" + ".join(f"{t!r} * sin({2 * j} * c)" for j, t in enumerate(projection.latitude_terms(_N), 1))}) lat from chi)"""


@query(f"with {GRID} select id, zone, round(x, 4) x, round(y, 4) y from grid")
def utm_places(spark, sf_dir):
    p = views.places(spark, sf_dir).withColumn("zone", (F.floor((F.col("lon") + 180) / 6) + 1).cast("int"))
    at = projection.to_grid(F.col("lon") - (F.col("zone") * 6 - 183), F.col("lat"), _ZERO)
    made = p.select("id", "zone", "lat", at.alias("at")).select("id", "zone", F.col("at.x").alias("x"), (F.when(F.col("lat") < 0, 10_000_000.0).otherwise(0.0) + F.col("at.y")).alias("y"))
    return rounded(made, "x", "y", digits=4)


#: Suppliers as rectangles of zone 36 north, in metres.
BOXES = """boxes as (select s_suppkey id, 300000.0 + s_suppkey * 977 % 300000 west, 3000000.0 + s_suppkey * 7919 % 2000000 south,
  300000.0 + s_suppkey * 977 % 300000 + 20000 + s_suppkey % 9 * 1000 east, 3000000.0 + s_suppkey * 7919 % 2000000 + 30000 north from supplier)"""
_CORNERS = "corners as (select id, unnest([0, 1, 2, 3, 4]) k, [west, east, east, west, west] xs, [south, south, north, north, south] ys from boxes)"
_EDGE = """edge as (select id, (k * 21 + j.j) i, xs[k + 1] + (xs[k + 2] - xs[k + 1]) * j.j / 20 x, ys[k + 1] + (ys[k + 2] - ys[k + 1]) * j.j / 20 y from corners, range(0, 21) j(j) where k < 4)"""


def boxes(spark, sf_dir):
    s = F.col("s_suppkey")
    west, south = 300000.0 + s * 977 % 300000, 3000000.0 + s * 7919 % 2000000
    return views.table(spark, sf_dir, "supplier").select(s.alias("id"), west.alias("west"), south.alias("south"), (west + 20000 + s % 9 * 1000).alias("east"), (south + 30000).alias("north"))


_UTM36 = projection.utm(32636)


@query(f"with {BOXES}, {_CORNERS}, {_EDGE}, {_inverse('edge')} select id, i, round(lon, 8) lon, round(lat, 8) lat from degrees_")
def densified_areas(spark, sf_dir):
    ring = projection.geographic(projection.densified(*[F.col(c) for c in ("west", "south", "east", "north")]), _UTM36)
    made = boxes(spark, sf_dir).select("id", F.posexplode(ring).alias("i", "p")).select("id", F.col("i").cast("long").alias("i"), F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))
    return rounded(made, "lon", "lat", digits=8)


@query(f"""with {BOXES}, four as (select id, unnest([0, 1, 2, 3]) i, [west, east, west, east] xs, [north, north, south, south] ys from boxes),
  points as (select id, i, xs[i + 1] x, ys[i + 1] y from four), {_inverse('points')},
  mercator as (select id, i, {math.pi * 6378137.0!r} * lon / 180 x, {math.pi * 6378137.0!r} * ln(tan(pi() / 4 + radians(lat) / 2)) / pi() y from degrees_)
  select id, round(max(x) filter (i in (0, 2)), 3) west, round(max(y) filter (i in (2, 3)), 3) south, round(min(x) filter (i in (1, 3)), 3) east, round(min(y) filter (i in (0, 1)), 3) north from mercator group by id""")
def inscribed_extents(spark, sf_dir):
    made = boxes(spark, sf_dir).select("id", projection.inscribed(*[F.col(c) for c in ("west", "south", "east", "north")], _UTM36).alias("r")).select("id", "r.*")
    return rounded(made, "west", "south", "east", "north", digits=3)


@query(f"""with {BOXES}, {_CORNERS}, {_EDGE}, {_inverse('edge')}, d as (select id, i, lon - first_value(lon) over w x, lat - first_value(lat) over w y from degrees_ window w as (partition by id order by i)),
  s as (select id, x * lead(y) over w - lead(x) over w * y a from d window w as (partition by id order by i)) select id, round(abs(sum(a)) / 2, 10) area from s group by id""")
def footprint_areas(spark, sf_dir):
    ring = projection.geographic(projection.densified(*[F.col(c) for c in ("west", "south", "east", "north")]), _UTM36)
    return rounded(boxes(spark, sf_dir).select("id", ring.alias("ring")).select("id", projection.ring_area(F.col("ring")).alias("area")), "area", digits=10)


def footprints(spark, sf_dir):
    """Suppliers as scenes: quadrilaterals that lean, in the unit of the area of interest."""
    s = F.col("s_suppkey")
    x, y, lean = s * 37 % 90 * 1.0, s * 53 % 90 * 1.0, s % 5 * 1.5
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(point(x + lean, y), point(x + 20 + lean, y + 2), point(x + 20, y + 21), point(x, y + 19))
    return views.table(spark, sf_dir, "supplier").select(s.cast("string").alias("id"), (s % 11).cast("string").alias("tile_id"), (s % 7).cast("double").alias("cloud_cover"), ring.alias("ring"), F.timestamp_seconds(1_700_000_000 + s * 3600).alias("acquired"), (s % 6 != 0).alias("online"))


#: The area of interest of the footprints: an octagon.
AOI = [(20.0, 5.0), (75.0, 0.0), (98.0, 30.0), (95.0, 80.0), (70.0, 100.0), (30.0, 96.0), (4.0, 70.0), (0.0, 25.0)]


@query()
def footprint_cover(spark, sf_dir):
    p = scenes.inside(footprints(spark, sf_dir), AOI)
    best = scenes.best_per_tile(p).select("id", F.lit(True).alias("chosen"))
    p = p.where("online and area > 0").join(best, "id", "left").withColumn("best", F.coalesce("chosen", F.lit(False)))
    return scenes.greedy_cover(p, AOI)


# outputs


@query("""select p_partkey id, p_partkey % 5 kind, case p_partkey % 5 when 0 then p_size * 7 - 40 between 0 and 255 when 1 then p_size * 7 - 40 between -128 and 127 when 2 then true
    when 3 then (p_retailprice * 100 % 100) = 0 and p_retailprice between 0 and 65535 else cast(cast(p_retailprice as float) as double) = p_retailprice end fits from part""")
def nodata_fits(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    kind = (F.col("p_partkey") % 5).cast("long")
    small, price = (F.col("p_size") * 7 - 40).cast("string"), F.col("p_retailprice").cast("double").cast("string")
    names = F.array(*[F.lit(x) for x in ("uint8", "int8", "int16", "uint16", "float32")])
    value = F.when(kind <= 2, small).otherwise(price)
    return p.select(F.col("p_partkey").alias("id"), kind.alias("kind"), text.output_nodata(value, F.element_at(names, (kind + 1).cast("int"))).isNotNull().alias("fits"))


@query("""select p_partkey id, case when p_partkey % 3 > 0 and p_size * 9 - 60 between 0 and 255 then cast(p_size * 9 - 60 as integer) end fill from part""")
def byte_fills(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    written = F.concat((F.col("p_size") * 9 - 60).cast("string"), F.element_at(F.array(F.lit(".5"), F.lit(""), F.lit(".0")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return p.select(F.col("p_partkey").alias("id"), text.byte_fill(written).alias("fill"))


@query("""with f as (select p_partkey id, ['data', p_brand, 'v' || (p_size % 3), p_type] t, ['data', 'Brand#' || (11 + p_partkey % 3), 'v' || (p_partkey % 2)] b from part),
  c as (select *, case when t[1:3] = b then 3 when t[1:2] = b[1:2] then 2 when t[1] = b[1] then 1 else 0 end n from f)
  select id, repeat('../', cast(3 - n as integer)) || array_to_string(t[n + 1:], '/') || '.tif' path from c""")
def relative_paths(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    target = F.concat(F.lit("/data/"), "p_brand", F.lit("/v"), (F.col("p_size") % 3).cast("string"), F.lit("/"), "p_type", F.lit(".tif"))
    folder = F.concat(F.lit("/data/Brand#"), (11 + F.col("p_partkey") % 3).cast("string"), F.lit("/v"), (F.col("p_partkey") % 2).cast("string"))
    return spread(p.select("p_partkey", "p_brand", "p_size", "p_type")).select(F.col("p_partkey").alias("id"), text.relative_path(target, folder).alias("path"))


_STATE = """plan as (select distinct o_custkey % 997 b from orders), state as (select distinct c_custkey % 1009 b, c_custkey % 1009 * 3 bytes, md5((c_custkey % 1009)::varchar) s from customer where c_custkey % 4 > 0),
  files as (select distinct s_suppkey % 1013 b, s_suppkey % 1013 * 3 + (s_suppkey % 1013 % 7 = 0)::integer bytes, md5((s_suppkey % 1013)::varchar) s from supplier)"""


@query(f"""with {_STATE}, every as (select b from plan union select b from state union select b from files)
  select 'block_' || b block, case when b not in (select b from plan) then 'unexpected' when exists (select 1 from state s join files f on s.b = f.b and s.bytes = f.bytes and s.s = f.s where s.b = e.b) then 'done'
    when b in (select b from state union select b from files) then 'again' else 'pending' end status from every e""")
def resumed_blocks(spark, sf_dir):
    t = lambda name: views.table(spark, sf_dir, name)
    named = lambda b: F.concat(F.lit("block_"), b.cast("string")).alias("block")
    plan = t("orders").select(named(F.col("o_custkey") % 997)).distinct()
    c, s = F.col("c_custkey") % 1009, F.col("s_suppkey") % 1013
    state = t("customer").where("c_custkey % 4 > 0").select(named(c), (c * 3).alias("bytes"), F.md5(c.cast("string")).alias("sha256"))
    files = t("supplier").select(named(s), (s * 3 + (s % 7 == 0).cast("int")).alias("bytes"), F.md5(s.cast("string")).alias("sha256"))
    return planning.resumption(plan, state, files)


@query(f"with {views.MOSAIC} select band, x, y, v from mosaic")
def masked_mosaic(spark, sf_dir):
    """The mosaic of samples through a file whose mask directory alone says which cells have one; zeros elsewhere are samples like any other."""
    geotiff.register(spark)
    made = _last(spark, sf_dir).select(F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("ord"), "band", "x", "y", "v", F.lit(True).alias("valid"))
    packed = tiles.pack(made, 32).select(F.format_string("band_%d", "band").alias("block"), F.lit(1).alias("band"), F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), "samples", tiles.packed_bits("valid").alias("valid"))
    path = scratch(spark)
    packed.repartition("block").sortWithinPartitions("block").write.format("geotiff").mode("append").options(path=path, edge=32, width=64, height=64, bands=1, mask="yes", compression="zstd").save()
    read = spark.read.format("geotiff").load(path)
    band = F.regexp_extract("path", r"band_(\d+)", 1).cast("int")
    return tiles.window_cells(read.withColumn("band", band)).select("band", "x", "y", "v")


@query(f"""with {views.RECTS} select ord block, '<VRTDataset rasterXSize="' || w || '" rasterYSize="' || h || '"><SRS>EPSG:3857</SRS><GeoTransform>' || (x * 1.0) || ',1.0,0.0,' || (y * 1.0)
  || ',0.0,-1.0</GeoTransform><VRTRasterBand dataType="Int16" band="1"><NoDataValue>-9999</NoDataValue><SimpleSource><SourceFilename relativeToVRT="1">../in/' || (ord % 10) || '/a&amp;b.tif</SourceFilename><SourceBand>1</SourceBand>'
  || '<SrcRect xOff="' || 0 || '" yOff="' || 0 || '" xSize="' || w || '" ySize="' || h || '"/><DstRect xOff="0" yOff="0" xSize="' || w || '" ySize="' || h || '"/>'
  || '</SimpleSource></VRTRasterBand></VRTDataset>' vrt from rects""")
def block_texts(spark, sf_dir):
    r = views.rects(spark, sf_dir)
    grid = F.array(F.col("x").cast("double"), F.lit(1.0), F.lit(0.0), F.col("y").cast("double"), F.lit(0.0), F.lit(-1.0))
    blocks = r.select(F.col("ord").alias("block"), "x", "y", "w", "h", grid.alias("grid"))
    src = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    parts = r.select(
        F.col("ord").alias("block"), F.lit(0).alias("ordinal"), F.lit("SimpleSource").alias("kind"), F.concat(F.lit("/job/in/"), (F.col("ord") % 10).cast("string"), F.lit("/a&b.tif")).alias("path"),
        src.alias("src"), F.struct("x", "y", "w", "h").alias("dst"), F.lit(False).alias("skip_nodata"), F.lit(False).alias("use_mask"), "x", "y", "w", "h",
    )
    return vrt.block_vrts(blocks, parts, "Int16", "-9999", "EPSG:3857", folder="/job/out")


_QUARTERS = ", ".join(map(str, codecs.LZMA_QUARTERS))


@query(f"""with s as (select p_partkey id, ['none', 'packbits', 'lzma', 'lzw', 'deflate', 'zstd', 'jpeg'][p_partkey % 7 + 1] c, case when p_partkey % 3 > 0 then p_size - 4 end a, 1 + p_partkey // 7 % 4 p, p_partkey % 2 = 0 f from part),
  u as (select *, case when c in ('lzma', 'deflate') then coalesce(a, 6) when c = 'zstd' then coalesce(a, 9) end l,
    case when c = 'jpeg' then 'unknown codec' when c = 'deflate' and a not between 1 and 9 then 'deflate levels are 1 to 9' when c = 'zstd' and a not between 1 and 22 then 'zstd levels are 1 to 22' when c = 'lzma' and a not between 0 and 9 then 'lzma levels are 0 to 9'
      when c not in ('deflate', 'zstd', 'lzma') and a is not null then 'this codec has no levels' when p > 3 then 'predictors are 1 to 3' when p > 1 and c not in ('lzw', 'deflate', 'zstd') then 'this codec takes no predictor'
      when p = 3 and not f then 'predictor 3 is for floating-point samples' end fault from s)
  select id, fault, case when fault is null then cast(l as integer) end "level", case when fault is null then cast(case c when 'lzma' then 33554432 + [{_QUARTERS}][l + 1] * 3145728 when 'zstd' then case when l <= 9 then 32 when l <= 15 then 64 when l <= 19 then 256 else 1024 end * 1048576 else 4194304 end as bigint) end memory_bytes from u""")
def codec_plans(spark, sf_dir):
    p, k = views.table(spark, sf_dir, "part"), F.col("p_partkey")
    codec = F.element_at(F.array(*[F.lit(c) for c in ("none", "packbits", "lzma", "lzw", "deflate", "zstd", "jpeg")]), (k % 7 + 1).cast("int"))
    rows = p.select(k.alias("id"), codec.alias("codec"), F.when(k % 3 > 0, F.col("p_size") - 4).cast("int").alias("asked"), (1 + F.floor(k / 7) % 4).cast("int").alias("predictor"), (k % 2 == 0).alias("floating"))
    rows = rows.withColumns({"level": codecs.level(F.col("codec"), F.col("asked")), "fault": codecs.fault(*[F.col(c) for c in ("codec", "asked", "predictor", "floating")])})
    fine = lambda c: F.when(F.col("fault").isNull(), c)
    return rows.select("id", "fault", fine(F.col("level")).alias("level"), fine(codecs.memory_bytes(F.col("codec"), F.col("level"))).alias("memory_bytes"))
