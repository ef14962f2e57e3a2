"""More registered queries: functions of names, grids and images, checks, samples and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import mercator, ranks, rects, text
from gridloom.operators import benchmark, mosaic, planning, resample, scenes, stats
from gridloom.plans import views
from gridloom.plans.queries import _STATS, SQL, _last, _uniform, longs, query, rounded
from gridloom.sources import fixtures, sqlite, telemetry, vector
from gridloom.streaming.requests import once, sessions

# checks of sources and results


@query(f"""with {views.CELLS}, c as (select band, x // 16 bx, case when valid then v end v, case when valid and v < 49 then v end w from cells),
  a as (select band, bx, {_STATS} from c group by all), b as (select band, bx, {_STATS.replace("(v)", "(w)")} from c group by all)
  select a.band, a.bx from a join b on a.band = b.band and a.bx = b.bx where (a.minimum, a.maximum, a.valid_pixels) is distinct from (b.minimum, b.maximum, b.valid_pixels) or abs(a.mean - b.mean) > 1e-9 or abs(a.stddev - b.stddev) > 1e-9""")
def statistics_compare(spark, sf_dir):
    c = views.cells(spark, sf_dir).withColumn("bx", F.floor(F.col("x") / 16))
    keys = ["band", "bx"]
    return stats.statistics_differ(stats.statistics(c, keys), stats.statistics(c.withColumn("valid", F.col("valid") & (F.col("v") < 49)), keys), keys)


@query(f"""with {views.CELLS}, c as (select band, x, y, case when v = 13 then 'nan'::double when v = 17 then 'inf'::double else v end v from cells where valid),
  f as (select *, row_number() over (partition by band order by y, x) r, count(*) over (partition by band) n from c where isnan(v) or isinf(v)) select band, y, x, n from f where r = 1""")
def non_finite_samples(spark, sf_dir):
    c = views.cells(spark, sf_dir)
    return mosaic.non_finite(c.withColumn("v", F.when(F.col("v") == 13, float("nan")).when(F.col("v") == 17, float("inf")).otherwise(F.col("v"))))


@query("""select l_returnflag flag, cast(count(*) filter (not (l_quantity = 7 and l_linenumber = 2)) as bigint) pixels, cast(count(*) filter (l_quantity <> 7 and l_linenumber <> 2) as bigint) every_band from lineitem group by 1""")
def tuple_nodata(spark, sf_dir):
    t = views.table(spark, sf_dir, "lineitem").select("l_returnflag", F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")).alias("p"))
    gone = F.array(F.lit(7.0), F.lit(2.0))
    one = mosaic.valid_sample(F.get("p", F.lit(0)), F.lit(7.0)) & mosaic.valid_sample(F.get("p", F.lit(1)), F.lit(2.0))
    return t.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_if(mosaic.valid_tuple(F.col("p"), gone)).alias("pixels"), F.count_if(one).alias("every_band"))


@query("""with p as (select p_partkey ord, p_size % 3 bands, case when p_partkey % 7 = 0 then null when p_partkey % 5 = 0 then 'nan'::double else p_size % 2 end nodata from part),
  f as (select bands b, nodata n from p order by ord limit 1) select ord from p, f where (bands, nodata) is distinct from (b, n)""")
def incompatible_sources(spark, sf_dir):
    k = F.col("p_partkey")
    nodata = F.when(k % 7 == 0, None).when(k % 5 == 0, float("nan")).otherwise((F.col("p_size") % 2).cast("double"))
    p = views.table(spark, sf_dir, "part").select(k.alias("ord"), (F.col("p_size") % 3).alias("bands"), nodata.alias("nodata"))
    return mosaic.compatible(p, ["bands", "nodata"]).select("ord")


@query("""with e as (select o_custkey % 40 block, o_orderstatus state from orders), a as (select o_custkey % 41 block, o_orderstatus state from orders where o_orderkey % 9 <> 0)
  select block, state, 'missing' side, count(*) n from (select * from e except all select * from a) group by all union all select block, state, 'unexpected', count(*) from (select * from a except all select * from e) group by all""")
def state_differences(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    e = o.select((F.col("o_custkey") % 40).alias("block"), F.col("o_orderstatus").alias("state"))
    a = o.where("o_orderkey % 9 <> 0").select((F.col("o_custkey") % 41).alias("block"), F.col("o_orderstatus").alias("state"))
    return planning.set_difference(e, a).groupBy("block", "state", "side").agg(F.count("*").alias("n"))


@query(f"""with {views.MOSAIC}, w as (select band, x, y, v, cast(floor(x / 2.5) as bigint) + i.i tx, cast(floor(y / 2.5) as bigint) + j.j ty from mosaic, range(2) i(i), range(2) j(j)),
  s as (select *, greatest(0, least(x + 1, (tx + 1) * 2.5) - greatest(x, tx * 2.5)) * greatest(0, least(y + 1, (ty + 1) * 2.5) - greatest(y, ty * 2.5)) a from w)
  select band, tx x, ty y, round(sum(v * a) / sum(a), 6) v, round(sum(abs(v) * a) / sum(a) * (8 * {resample.EPSILON!r}::double + 4 * (16 * {resample.EPSILON!r}::double / (1 - 16 * {resample.EPSILON!r}::double))) * 1e12, 6) error from s where a > 0 group by all""")
def average_error_bounds(spark, sf_dir):
    made = resample.average(_last(spark, sf_dir), 2.5, 2.5, with_error=True)
    return rounded(made.withColumn("error", F.col("error") * 1e12), "v", "error")


@query(f"select cast(sum(reserved_bytes) as bigint) reserved_bytes from (select reserved_bytes from ({SQL['storage_estimates']}) order by reserved_bytes desc limit 8)")
def largest_reservations(spark, sf_dir):
    from gridloom.plans.queries import storage_estimates

    return longs(planning.largest_reservations(storage_estimates(spark, sf_dir), 8), "reserved_bytes")


@query(f"""with {views.RECTS} select x // 100 gx, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h from rects group by 1""")
def enclosing_rectangles(spark, sf_dir):
    return views.rects(spark, sf_dir).groupBy(F.floor(F.col("x") / 100).alias("gx")).agg(rects.enclosing().alias("r")).select("gx", "r.*")


@query(f"""with {views.RECTS}, s as (select ord, (x * w * h) % 1000000 * 2500 bytes from rects) select ord, bytes, cast(ceil(bytes / 4000000.0) as bigint) parts from s where bytes > 4400000""")
def oversized_outputs(spark, sf_dir):
    r = views.rects(spark, sf_dir).select("ord", (F.col("x") * F.col("w") * F.col("h") % 1000000 * 2500).alias("bytes"))
    return longs(planning.oversized(r, 4_000_000), "bytes", "parts")


@query(f"""with w as (select o_custkey source, o_orderkey "window", o_orderkey % 900 + 50 bytes, 100 pixels from orders),
  r as (select *, row_number() over (partition by source order by {_uniform("1", "source", '"window"')}, "window") i from w) select source, round(cast(sum(bytes) as double) / sum(pixels), 9) bytes_per_pixel from r where i <= 8 group by source""")
def compression_density(spark, sf_dir):
    w = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("window"), (F.col("o_orderkey") % 900 + 50).alias("bytes"), F.lit(100).alias("pixels"))
    return rounded(planning.density(w), "bytes_per_pixel", digits=9)


# grids, views and overviews


@query(f"""with {views.PLACES}, b as (select id, {mercator.HALF!r}::double * lon / 180 x, {mercator.HALF!r}::double * ln(tan(pi() / 4 + radians(lat) / 2)) / pi() y, 2 * {mercator.HALF!r}::double / power(2.0::double, z) / 256 s from places)
  select id, round(x - s * 640, 3) west, round(y - s * 360, 3) south, round(x + s * 640, 3) east, round(y + s * 360, 3) north from b""")
def view_boxes(spark, sf_dir):
    p = views.places(spark, sf_dir).select("id", mercator.view_bbox(F.col("lon"), F.col("lat"), F.col("z"), 1280, 720).alias("b"))
    return rounded(p.select("id", "b.*"), "west", "south", "east", "north", digits=3)


@query("""with p as (select p_partkey k, p_partkey * 3 + 1 w, p_size * 5 + 1 h from part), f as (select k, w, h, cast(power(2, l.l) as bigint) f from p, range(1, 25) l(l))
  select k, f factor, cast(floor(0.5 + (k % 10) * cast(w as double) / ceil(w / cast(f as double))) as bigint) source from f where f / 2 < greatest(w, h)""")
def overview_indices(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 3 + 1).alias("w"), (F.col("p_size").cast("long") * 5 + 1).alias("h"))
    f = p.select("k", "w", F.explode(rects.overview_factors(F.col("w"), F.col("h"))).alias("factor"))
    ratio = F.col("w").cast("double") / F.ceil(F.col("w") / F.col("factor"))
    return longs(f.select("k", "factor", rects.overview_index(F.col("k") % 10, ratio).alias("source")), "factor", "source")


@query(f"""with {views.RECTS}, g as (select ord, x, y, w, h, 100.0::double + x * 0.25 c, 50.0::double - y * 0.5 f from rects)
  select ord, c + 3 * 0.25 at_x, f - 2 * 0.5 at_y, x - 10 in_x, y - 20 in_y, cast(floor((x - 0) / 3.0) as bigint) ox, cast(floor(y / 2.0) as bigint) oy,
    cast(ceil((x + w) / 3.0) - floor(x / 3.0) as bigint) ow, cast(ceil((y + h) / 2.0) - floor(y / 2.0) as bigint) oh from g""")
def grid_places(spark, sf_dir):
    r = views.rects(spark, sf_dir).withColumn("r", F.struct("x", "y", "w", "h"))
    world = F.struct(*[F.lit(v).alias(k) for k, v in zip("cabfde", (100.0, 0.25, 0.0, 50.0, 0.0, -0.5), strict=True)])
    at = rects.located(rects.shifted(world, F.col("x"), F.col("y")), 3, 2)
    inner, out = rects.within(F.col("r"), rects.rect(10, 20, 500, 500)), rects.output_footprint(F.col("r"), rects.rect(0, 0, 5000, 5000), F.lit(3.0), F.lit(2.0))
    made = r.select("ord", at.alias("a"), inner.alias("i"), out.alias("o"))
    made = made.select("ord", F.col("a.x").alias("at_x"), F.col("a.y").alias("at_y"), F.col("i.x").alias("in_x"), F.col("i.y").alias("in_y"), *[F.col(f"o.{k}").alias(f"o{k}") for k in "xywh"])
    return longs(made, "ox", "oy", "ow", "oh")


# names, texts and images


_NAMES = "concat(case p_size % 6 when 0 then 'con' when 1 then '.hidden' when 2 then 'a b' when 3 then 'Lpt1.tif' when 4 then 'ok-name_1.tif' else 'end.' end, case when p_partkey % 4 = 0 then p_brand else '' end)"


@query(f"""with n as (select p_partkey k, {_NAMES} name from part) select k, regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9._-]*$') and not regexp_matches(name, '[. ]$')
  and not regexp_matches(upper(name), '^({text.RESERVED})(\\..*)?$') portable, regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9_-]*$') prefix from n""")
def portable_names(spark, sf_dir):
    n = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr(_NAMES).alias("name"))
    return n.select("k", text.portable_name(F.col("name")).alias("portable"), text.output_prefix(F.col("name")).alias("prefix"))


@query("""select p_partkey k, case when p_partkey % 3 <> 0 then p_size end width, case when p_partkey % 3 <> 0 then p_partkey * 70000 % 4294967295 end height, p_partkey % 3 <> 0 and p_partkey % 2 = 0 and p_size = 7 "image" from part""")
def png_headers(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    number = lambda v: F.lpad(F.hex(v.cast("long")), 8, "0")
    head = F.when(k % 3 == 0, "3C3F786D6C20766572736F6E").otherwise("89504E470D0A1A0A")
    data = F.unhex(F.concat(head, F.lit("0000000D49484452"), number(size), number(k * 70000 % 4294967295)))
    kind = F.when(k % 2 == 0, "image/png").otherwise("text/xml")
    p = views.table(spark, sf_dir, "part").select(k.alias("k"), data.alias("d"), kind.alias("t"), size.alias("s"), (k * 70000 % 4294967295).alias("h"))
    found = p.select("k", text.png_size(F.col("d")).alias("p"), F.coalesce(text.image_response(F.col("t"), F.col("d"), 7, F.col("h")), F.lit(False)).alias("image"))
    return found.select("k", F.col("p.width").cast("int").alias("width"), F.col("p.height").alias("height"), "image")


@query("""select o_orderkey k, 'usage_usec' name, o_custkey "value" from orders union all select o_orderkey, 'nr_periods', o_orderkey % 100 from orders""")
def key_value_texts(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    lines = F.concat(F.lit("usage_usec "), F.col("o_custkey").cast("string"), F.lit("\r\nbad line here\nword x1\n  nr_periods   "), (F.col("o_orderkey") % 100).cast("string"), F.lit("\n"))
    return o.select(F.col("o_orderkey").alias("k"), F.explode(text.number_map(lines)).alias("name", "value"))


@query("""select event_id k, event_id * 3 cpu, event_id * 2048 rss_bytes, event_id * 1024 available_bytes, event_id % 77 cache_bytes, (event_id % 50 + 1.5) * 1024 heap_bytes from events""")
def telemetry_texts(spark, sf_dir):
    e = F.col("event_id")
    s = lambda v: v.cast("string")
    parts = ["SECTION:cpu.stat\nusage_usec ", s(e * 3), "\nSECTION:process\nName: x\nVmRSS:\t", s(e * 2), " kB\nSECTION:vm\nMemAvailable:   ", s(e), " kB\nSECTION:cache\n", s(e % 77), "\t/cache\nSECTION:jstat\n S0U S1U EU OU\n 0.5 1.0 ", s(e % 50), " 0.0\n"]
    t = views.table(spark, sf_dir, "events").select(e.alias("k"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("value"))
    made = telemetry.samples(t)
    return made.select("k", F.try_element_at("cpu", F.lit("usage_usec")).alias("cpu"), "rss_bytes", "available_bytes", "cache_bytes", "heap_bytes")


@query("""select p_partkey k, 'AREA_OR_POINT' name, p_brand "value" from part union all select p_partkey, 'STATISTICS_MINIMUM', cast(p_size as varchar) from part union all select p_partkey, 'STATISTICS_MAXIMUM', p_brand from part where p_partkey % 2 = 0""")
def metadata_maps(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    old = F.create_map(F.lit("AREA_OR_POINT"), F.col("p_brand"), F.lit("Statistics_Mean"), F.lit("1"))
    new = text.statistics_metadata(minimum=F.col("p_size"), maximum=F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")))
    return p.select(F.col("p_partkey").alias("k"), F.explode(F.map_concat(text.semantic_metadata(old), new)).alias("name", "value"))


# quality of images


@query(f"""with {views.TILES8}, p as (select src, v * 100 a, v * 100 + (src % 7) * (x - y) b from tiles8), m as (select src, avg(a) ma, avg(b) mb, var_pop(a) va, var_pop(b) vb, covar_pop(a, b) c from p group by src)
  select src, round(((2 * ma * mb + 6.5025) * (2 * c + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)), 6) ssim from m""")
def window_ssim(spark, sf_dir):
    t = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"), F.transform("embedding", lambda v: v.cast("double") * 100).alias("a"))
    b = F.transform("a", lambda v, i: v + (F.col("src") % 7) * (i % 8 - F.floor(i / 8)))
    return rounded(t.select("src", stats.ssim(F.col("a"), b).alias("ssim")), "ssim")


@query("""select cast(count(*) filter (l_quantity > 25 or l_linenumber > 5) as double) / count(*) valid_fraction, count(*) pixels from lineitem""")
def valid_pixel_fraction(spark, sf_dir):
    t = views.table(spark, sf_dir, "lineitem")
    bands = F.array(F.when(F.col("l_quantity") > 25, 1).otherwise(0), F.when(F.col("l_linenumber") > 5, 1).otherwise(0))
    return stats.valid_fraction(t.select(bands.alias("bands")))


@query(f"""with {views.TILES8}, p as (select src % 4 "level", v * 100 a, case when src % 3 = 0 then v * 100 else v * 100 + 1 end b from tiles8)
  select "level", cast(count(*) filter (a <> b) as bigint) differing, round(sqrt(avg((a - b) * (a - b))), 6) rmse, count(*) samples from p group by 1""")
def overview_quality(spark, sf_dir):
    p = views.tiles8(spark, sf_dir).select((F.col("src") % 4).alias("level"), (F.col("v") * 100).alias("a"), F.when(F.col("src") % 3 == 0, F.col("v") * 100).otherwise(F.col("v") * 100 + 1).alias("b"), F.lit(True).alias("valid"))
    return rounded(stats.quality(p, ["level"]).select("level", "differing", "rmse", "samples"), "rmse")


@query(f"""select band.b band, x.x x, y.y y, case when x.x < 8 and y.y < 8 then 0.0::double else floor({_uniform("3", "band.b", "x.x", "y.y")} * 256) end v from range(1, 4) band(b), range(48) x(x), range(32) y(y)""")
def fixture_samples(spark, sf_dir):
    return fixtures.noise(spark, 48, 32, 3, corner=8, seed=3).select(F.col("band").cast("long").alias("band"), "x", "y", "v")


# benchmark reports


@query("""select o_orderstatus phase, count(*) cells, sum(o_custkey % 9) views, sum(o_custkey % 90) requests, sum(o_orderkey % 2) failed_views, max(o_totalprice) worst_p95 from orders group by 1""")
def final_totals(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderstatus").alias("phase"), (F.col("o_custkey") % 9).alias("views"), (F.col("o_custkey") % 90).alias("requests"), (F.col("o_orderkey") % 2).alias("failed_views"), F.col("o_totalprice").alias("p95"))
    return longs(benchmark.final_totals(runs), "views", "requests", "failed_views")


@query("""with a as (select l_orderkey tile, l_linenumber attempt, l_returnflag = 'R' ok from lineitem where l_linenumber <= 3)
  select tile, cast(max(attempt) as integer) attempts, bool_or(ok) done, not bool_or(ok) and max(attempt) >= 3 failed from a group by tile""")
def preseed_attempts(spark, sf_dir):
    t = views.table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("tile"), F.col("l_linenumber").cast("int").alias("attempt"), (F.col("l_returnflag") == "R").alias("ok"))
    return benchmark.attempts(t)


@query("""select o_orderstatus phase, count(*) cells, count(*) * 90.0::double / 3600 as "hours" from orders group by 1 union all select null, count(*), count(*) * 90.0::double / 3600 from orders""")
def matrix_estimate(spark, sf_dir):
    return benchmark.matrix_totals(views.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("phase")), 90.0)


@query("""select case when o_orderkey % 11 = 0 then 'skipped' when o_orderstatus = 'F' then 'failed' else 'ok' end status, count(*) n from orders group by 1""")
def status_totals(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    return benchmark.status_counts(o.select(F.when(F.col("o_orderkey") % 11 == 0, "skipped").when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status")))


@query("""select c_custkey variant, c_acctbal > 0 and c_custkey % 6 <> 0 compatible, case when c_custkey % 4 <> 0 then c_acctbal end psnr,
  case when c_custkey % 6 = 0 then 'unprobed' when c_acctbal <= 0 then 'incompatible' when c_nationkey < 5 then 'downgraded' when c_custkey % 4 = 0 then 'unmeasured' else 'ok' end status from customer""")
def variant_report(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").withColumn("variant", F.col("c_custkey"))
    probed = c.where("c_custkey % 6 <> 0").select("variant", (F.col("c_acctbal") > 0).alias("compatible"), (F.col("c_nationkey") >= 5).alias("full_data"))
    return benchmark.variant_report(c, probed, c.where("c_custkey % 4 <> 0").select("variant", F.col("c_acctbal").alias("psnr")))


@query("""select o_orderstatus phase, count(*) latency_n, max(o_totalprice) latency_tail_most, min(o_totalprice) latency_tail_least, cast(count(*) filter (o_custkey % 2 = 0) as bigint) errors from orders group by 1""")
def flat_summary(spark, sf_dir):
    made = views.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("phase")).agg(
        F.struct(F.count("*").alias("n"), F.struct(F.max("o_totalprice").alias("most"), F.min("o_totalprice").alias("least")).alias("tail")).alias("latency"), F.count_if(F.col("o_custkey") % 2 == 0).alias("errors")
    )
    return benchmark.flattened(made)


@query("""select c_custkey, cast((row_number() over (order by c_nationkey, c_custkey) - 1) % 7 as integer) "user" from customer""")
def round_robin_users(spark, sf_dir):
    return benchmark.round_robin(views.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey", "c_custkey"], 7).select("c_custkey", "user")


@query("""select p_partkey id, row_number() over (order by cast(p_size as double) desc, 1700000000 + p_partkey * 3600, p_partkey) - 1 place from part where p_partkey % 5 <> 0""")
def mosaic_places(spark, sf_dir):
    online = views.products(spark, sf_dir).where("online")
    return ranks.running(scenes.mosaic_order(online), [F.desc("cloud_cover"), "acquired", "id"]).select("id", "place")


@query(f"""select o_orderkey, o_custkey from orders order by {_uniform("5", "o_orderkey")}, o_orderkey limit 64""")
def sampled_windows(spark, sf_dir):
    return ranks.seeded_sample(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 64, 5)


@query(f"""select c_custkey, row_number() over (order by {_uniform("9", "c_custkey")}, c_custkey) - 1 place from customer""")
def shuffled_variants(spark, sf_dir):
    return ranks.seeded_shuffle(views.table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 9)


@query("""select s_name, row_number() over (order by lower(s_name), s_name) - 1 ord from supplier order by lower(s_name), s_name limit 10""")
def first_sources(spark, sf_dir):
    s = ranks.running(views.table(spark, sf_dir, "supplier").select("s_name"), [F.lower("s_name"), "s_name"], place="ord")
    return ranks.preview(s, ["ord"])


@query("""with l as (select n_nationkey k, n_regionkey r from nation) select a.k, b.k other, case when a.k = b.k and a.r <> 0 and a.k % 3 <> 0 then case when a.k % 2 = 0 then 'EPSG:900913' else 'EPSG:3857' end end "set"
  from l a, l b where b.r = 1""")
def wmts_capabilities(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    formats = F.when(F.col("r") != 0, F.array(F.lit("image/jpeg"), F.lit("image/png"))).otherwise(F.array(F.lit("image/jpeg")))
    sets = F.when(F.col("k") % 3 == 0, F.array(F.lit("EPSG:4326"))).when(F.col("k") % 2 == 0, F.array(F.lit("EPSG:3857"), F.lit("EPSG:900913"))).otherwise(F.array(F.lit("EPSG:3857")))
    offers = n.select("k", F.array(F.struct(F.col("k").cast("string").alias("name"), formats.alias("formats"), sets.alias("matrix_sets"))).alias("layers"))
    asked = n.where("r = 1").select(F.col("k").alias("other"))
    return offers.crossJoin(asked).select("k", "other", mercator.advertised(F.col("layers"), F.col("other").cast("string"), F.lit("image/png")).alias("set"))


# tiles, vectors and evidence


@query("""select page_id % 5 zoom_level, count(*) tiles, cast(sum(octet_length(encode(html))) as bigint) bytes from pages group by 1""")
def zoom_payloads(spark, sf_dir):
    p = views.table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("zoom_level"), F.col("html").cast("binary").alias("tile_data"))
    return longs(sqlite.zoom_payload(p), "bytes")


@query("""with s as (select n_regionkey % 3 k, n_name layer from nation where n_nationkey % 4 = 0) select distinct layer from s where layer not in (select n_name from nation where n_nationkey % 8 = 0)""")
def layers_missing(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")
    return vector.missing_layers(n.where("n_nationkey % 4 = 0").select(F.col("n_name").alias("layer")), n.where("n_nationkey % 8 = 0").select(F.col("n_name").alias("layer")))


@query("""select n_name layer, f.f field, case when f.f = 'rank' and n_nationkey % 2 = 0 then 'String' when f.f = 'rank' then 'Number' else 'String' end kind from nation, (values ('name'), ('rank'), ('class')) f(f)
  where f.f <> 'class' or n_nationkey % 2 = 0""")
def schema_fields(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation").withColumn("layer", F.col("n_name"))
    required = n.select("layer", F.create_map(F.lit("name"), F.lit("String"), F.lit("rank"), F.lit("Number")).alias("fields"))
    own = n.where("n_nationkey % 2 = 0").select("layer", F.create_map(F.lit("rank"), F.lit("String"), F.lit("class"), F.lit("String")).alias("fields"))
    return vector.completed_schema(required, own).select("layer", F.explode("fields").alias("field", "kind"))


@query("""select s_suppkey k, case when s_suppkey % 3 <> 0 then 'POINT (' || s_suppkey || ' ' || s_nationkey || ')' end wkt from supplier""")
def label_points(spark, sf_dir):
    return views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), mercator.point_text(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey")), F.col("s_nationkey")).alias("wkt"))


@query("""select o_custkey % 30 file, o_orderstatus digest, o_custkey % 7 ordinal from orders group by all""")
def evidence_once(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    return once(o.select((F.col("o_custkey") % 30).alias("file"), F.col("o_orderstatus").alias("digest"), (F.col("o_custkey") % 7).alias("ordinal")))


@query(f"""with {views.REQUESTS}, g as (select "user", "at", case when "at" - lag("at") over w < interval 30 minute then 0 else 1 end n from requests window w as (partition by "user" order by "at")),
  s as (select "user", "at", sum(n) over (partition by "user" order by "at" rows unbounded preceding) k from g) select "user", min("at") "start", max("at") + interval 30 minute stop, count(*) requests from s group by "user", k""")
def user_sessions(spark, sf_dir):
    r = views.requests(spark, sf_dir).withColumn("at", F.col("at").cast("timestamp"))
    made = sessions(r)
    return made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})
