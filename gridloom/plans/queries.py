"""The registered queries of the raster, planning and log operators, and the same in DuckDB's SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import mercator, rects, text
from gridloom.functions.shared import scratch
from gridloom.operators import benchmark, mosaic, planning, resample, scenes, stats, tiles
from gridloom.plans import views
from gridloom.sources import geotiff
from gridloom.streaming.requests import cache_hits as metatile_hits
from gridloom.streaming.requests import drained, windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _last(spark, sf_dir) -> DataFrame:
    return mosaic.compose(views.cells(spark, sf_dir), "last")


# mosaics


@query(f"with {views.MOSAIC} select band, x, y, v from mosaic")
def mosaic_last(spark, sf_dir):
    return _last(spark, sf_dir)


@query(f"with {views.CELLS} select band, x, y, v from (select *, row_number() over (partition by band, x, y order by ord) r from cells where valid) where r = 1")
def mosaic_first(spark, sf_dir):
    return mosaic.compose(views.cells(spark, sf_dir), "first")


@query(f"with {views.CELLS} select band, x, y, v, valid from (select *, row_number() over (partition by band, x, y order by ord desc) r from cells) where r = 1")
def mosaic_overwrite(spark, sf_dir):
    return mosaic.overwrite(views.cells(spark, sf_dir))


@query(f"""with {views.CELLS} select band, x, y, v, valid from (select *, row_number() over (partition by band, x, y order by ord desc) r from cells
  where valid or not (src % 3 = 0 or src % 5 = 0)) where r = 1""")
def mosaic_overwrite_flags(spark, sf_dir):
    c = views.cells(spark, sf_dir).withColumn("skip_nodata", F.col("src") % 3 == 0).withColumn("use_mask", F.col("src") % 5 == 0)
    return mosaic.overwrite(c)


@query(f"with {views.CELLS} select band, x, y, bool_or(valid) valid from cells group by all")
def validity_union(spark, sf_dir):
    return mosaic.validity_union(views.cells(spark, sf_dir))


@query(f"""with {views.CELLS}, grid as (select a.range x, b.range y from range(64) a, range(64) b)
  select band, cast(x as bigint) x, cast(y as bigint) y from (select distinct band from cells), grid
  where not exists (select 1 from cells c where c.valid and c.band = band and false) and (band, x, y) not in (select (band, x, y) from cells where valid)""")
def uncovered_cells(spark, sf_dir):
    return mosaic.uncovered(views.cells(spark, sf_dir), 64, 64)


@query(f"""with {views.CELLS}, one as (select band, x, y, src, v from (select *, row_number() over (partition by band, x, y, src order by ord desc) r from cells where valid) where r = 1),
  met as (select a.src first_src, b.src second_src, a.band, a.x, a.y, a.v av, b.v bv from one a join one b on a.band = b.band and a.x = b.x and a.y = b.y and a.src < b.src)
  select first_src, second_src, count(distinct x * 64 + y) pixels, count(*) valid_band_samples, cast(count(*) filter (av <> bv) as bigint) conflicting_band_samples,
    min(y * 100000 + x * 100 + band) filter (av <> bv) example from met group by all""")
def overlap_conflicts(spark, sf_dir):
    made = mosaic.overlap_conflicts(views.cells(spark, sf_dir))
    return made.withColumn("example", F.col("example.y") * 100000 + F.col("example.x") * 100 + F.col("example.band"))


@query(f"""with {views.MOSAIC}, b as (select band, x, y, case when (x + y) % 17 = 0 then v + 1 else v end v from mosaic where x % 29 <> 3 union all
  select band, x + 64, y, v from mosaic where x = 5)
  select coalesce(mosaic.band, b.band) band, count(mosaic.v) expected, count(b.v) found, count(*) filter (b.v is null) missing, count(*) filter (mosaic.v is null) unexpected,
    count(*) filter (mosaic.v <> b.v) different from mosaic full join b on mosaic.band = b.band and mosaic.x = b.x and mosaic.y = b.y group by 1""")
def verify_differences(spark, sf_dir):
    m = _last(spark, sf_dir)
    b = m.where("x % 29 <> 3").withColumn("v", F.when((F.col("x") + F.col("y")) % 17 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return mosaic.verify(m, b.union(m.where("x = 5").withColumn("x", F.col("x") + 64)))


_RANKED = f"""with {views.POSTS}, made as (select *, unnest(range(greatest(0, x * factor - factor // 2), x * factor + (factor - 1) // 2 + 1)) t from posts),
  r as (select *, case when t % factor = 0 then 0 else factor end rank from made)"""


@query(_RANKED + " select band, cast(t as bigint) x, y, v, cast(rank as integer) rank from (select *, row_number() over (partition by band, t, y order by rank, ord) n from r where valid) where n = 1")
def post_mosaic(spark, sf_dir):
    return mosaic.ranked(resample.expand_posts(mosaic.first_posts(views.posts(spark, sf_dir))))


@query(_RANKED + " select band, cast(t as bigint) x, y, min(v) low, max(v) high from r where valid and rank = 0 group by band, t, y having min(v) <> max(v)")
def post_conflicts(spark, sf_dir):
    return mosaic.native_conflicts(resample.expand_posts(views.posts(spark, sf_dir)))


# statistics


_STATS = """min(v) minimum, max(v) maximum, round(avg(v), 6) mean, round(stddev_pop(v), 6) stddev, count(v) valid_pixels, count(*) - count(v) nodata_pixels, round(100.0 * count(v) / count(*), 6) valid_percent"""


@query(f"with {views.CELLS}, c as (select band, x // 16 bx, y // 16 by_, case when valid then v end v from cells) select band, bx, by_, {_STATS} from c group by all")
def block_statistics(spark, sf_dir):
    c = views.cells(spark, sf_dir).withColumn("bx", F.floor(F.col("x") / 16)).withColumn("by_", F.floor(F.col("y") / 16))
    return rounded(stats.statistics(c, ["band", "bx", "by_"]), "mean", "stddev", "valid_percent")


@query(f"""with {views.MOSAIC}, c as (select band, x // 16 tx, y // 16 ty, v from mosaic)
  select band, tx, ty, min(v) minimum, max(v) maximum, round(avg(v), 6) mean, round(stddev_pop(v), 6) stddev, count(v) valid_pixels, 256 - count(v) nodata_pixels from c group by all""")
def tile_statistics(spark, sf_dir):
    made = _last(spark, sf_dir).select(F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("ord"), "band", "x", "y", "v", F.lit(True).alias("valid"))
    return rounded(tiles.statistics(tiles.pack(made, 16), ["band", "tx", "ty"]), "mean", "stddev")


@query(f"""with {views.CELLS}, one as (select band, x, y, src, v from (select *, row_number() over (partition by band, x, y, src order by ord desc) r from cells where valid) where r = 1)
  select band, x, y, v from (select *, row_number() over (partition by band, x, y order by src desc) r from one) where r = 1""")
def tile_mosaic(spark, sf_dir):
    one = views.cells(spark, sf_dir).where("valid").groupBy("src", "band", "x", "y").agg(F.max_by("v", "ord").alias("v"))
    one = one.select("src", F.col("src").alias("ord"), "band", "x", "y", "v", F.lit(True).alias("valid"))
    return tiles.unpack(tiles.compose(tiles.pack(one, 32)), 32).select("band", "x", "y", "v")


@query(f"""with {views.MOSAIC}, c as (select band, v a, case when (x + y) % 17 = 0 then v + 3 else v end b, x % 11 <> 0 valid from mosaic)
  select band, round(avg(abs(a - b)) filter (valid), 6) mae, round(sqrt(avg((a - b) * (a - b)) filter (valid)), 6) rmse,
    round(case when avg((a - b) * (a - b)) filter (valid) > 0 then 10 * log10(65025 / (avg((a - b) * (a - b)) filter (valid))) end, 6) psnr,
    max(abs(a - b)) max_error, count(*) filter (a <> b) differing, count(*) samples from c group by band""")
def quality_metrics(spark, sf_dir):
    m = _last(spark, sf_dir)
    pairs = m.select("band", F.col("v").alias("a"), F.when((F.col("x") + F.col("y")) % 17 == 0, F.col("v") + 3).otherwise(F.col("v")).alias("b"), (F.col("x") % 11 != 0).alias("valid"))
    return rounded(stats.quality(pairs, ["band"]), "mae", "rmse", "psnr")


@query(f"""with {views.CELLS}, c as (select unnest([0, 1, 2]) ordinal, unnest([-9999.0, 17.0, 51.0]) candidate)
  select cast(ordinal as integer) ordinal, cast(candidate as double) candidate, exists (select 1 from cells where valid and v = candidate) occupied from c""")
def nodata_candidates(spark, sf_dir):
    return stats.occupied(views.cells(spark, sf_dir), [-9999.0, 17.0, 51.0])


def _key(v: str, bias: int, bits: int) -> str:
    """SQL: the IEEE bits of a number other than zero without its sign."""
    power = f"floor(log2(abs({v})))"
    return f"(cast({power} as bigint) + {bias}) * {1 << bits} + cast((abs({v}) / pow(2, {power}) - 1) * {1 << bits} as bigint)"


@query(f"""with v as (select c_custkey id, 'float64' kind, cast(c_acctbal as double) v from customer union all select c_custkey, 'float32', cast(cast(c_acctbal as float) as double) from customer)
  select id, kind, case when v = 0 then 0 when kind = 'float64' then {_key("v", 1023, 52)} + case when v < 0 then -9223372036854775808 else 0 end
  else {_key("v", 127, 23)} + case when v < 0 then 2147483648 else 0 end end as "key" from v
  union all select p_partkey, 'int16', p_size + 32768 from part""")
def value_keys(spark, sf_dir):
    c, p = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "part")
    floats = [c.select(F.col("c_custkey").alias("id"), F.lit(kind).alias("kind"), stats.value_key(F.col("c_acctbal"), kind).alias("key")) for kind in ("float64", "float32")]
    return floats[0].union(floats[1]).union(p.select("p_partkey", F.lit("int16"), stats.value_key(F.col("p_size"), "int16")))


@query("""with v as (select 'float64' kind, l_orderkey - 1 n from lineitem where l_quantity <> 17 union all select 'float32', l_partkey - 1 from lineitem where l_linenumber < 6
  union all select 'uint8', cast(l_quantity as bigint) - 1 from lineitem)
select k.kind, min(r.r) steps from (select kind, max(n) + 1 most from v group by kind) k, range(0, (select max(n) + 2 from v)) r(r) where r.r <= k.most and (k.kind, r.r) not in (select kind, n from v) group by k.kind""")
def unused_values(spark, sf_dir):
    """How many steps of the type's smallest number it is to the first value that no sample has."""
    t = views.table(spark, sf_dir, "lineitem")
    sides = {"float64": ("l_orderkey", "l_quantity <> 17", 2.0**-1074), "float32": ("l_partkey", "l_linenumber < 6", 2.0**-149), "uint8": ("l_quantity", "true", 1.0)}
    found = [
        stats.unused_value(t.where(kept).select(((F.col(name) - 1).cast("double") * step).alias("v"), F.lit(True).alias("valid")), kind).select(F.lit(kind).alias("kind"), F.rint(F.col("value") / step).cast("long").alias("steps"))
        for kind, (name, kept, step) in sides.items()
    ]
    return found[0].union(found[1]).union(found[2])


@query(f"with {views.CELLS} select min(range) unused from range(1, 256) where range not in (select cast(v as bigint) from cells where valid)")
def smallest_unused(spark, sf_dir):
    return stats.smallest_unused(views.cells(spark, sf_dir), 1, 255)


@query(f"with {views.CELLS} select src, cast(count(*) filter (valid) as bigint) valid_samples, cast(count(*) filter (not valid) as bigint) invalid_samples from cells group by src")
def sample_counts(spark, sf_dir):
    return stats.valid_counts(views.cells(spark, sf_dir), ["src"])


# resampling


_SHARES = """s as (select band, v, tx.t x, ty.t y, least(x + 1, (tx.t + 1) * 2.5) - greatest(x, tx.t * 2.5) wx, least(y + 1, (ty.t + 1) * 2.5) - greatest(y, ty.t * 2.5) wy
  from mosaic, range(26) tx(t), range(26) ty(t) where tx.t between floor(x / 2.5) and floor(x / 2.5) + 1 and ty.t between floor(y / 2.5) and floor(y / 2.5) + 1)"""


@query(f"with {views.MOSAIC}, {_SHARES} select band, x, y, round(cast(sum(v * wx * wy) / sum(wx * wy) as double), 6) v from s where wx > 0 and wy > 0 group by all")
def resample_average(spark, sf_dir):
    return rounded(resample.average(_last(spark, sf_dir), 2.5, 2.5), "v")


@query(f"with {views.MOSAIC} select band, x // 2 x, y // 2 y, least(255.0, greatest(0.0, round(avg(v)))) v from mosaic group by band, x // 2, y // 2")
def resample_average_integer(spark, sf_dir):
    return resample.average(_last(spark, sf_dir), 2.0, 2.0, integer=True, low=0, high=255)


@query(f"""with {views.MOSAIC}, t as (select a.range x, b.range y, cast(floor((a.range + 0.5) * 2.5) as bigint) sx, cast(floor((b.range + 0.5) * 2.5) as bigint) sy from range(26) a, range(26) b)
  select band, t.x, t.y, v from t join mosaic m on m.x = sx and m.y = sy""")
def resample_nearest(spark, sf_dir):
    return resample.nearest(_last(spark, sf_dir), 2.5, 2.5, 64, 64)


@query(f"""with {views.TILES8} select cast(l.l as integer) "level", src, x // cast(pow(2, l.l) as bigint) x, y // cast(pow(2, l.l) as bigint) y, round(avg(v), 6) v
  from tiles8, range(1, 4) l(l) group by all""")
def pyramid_levels(spark, sf_dir):
    return rounded(resample.pyramid(views.tiles8(spark, sf_dir), 3, ["src"]), "v")


@query(f"with {views.TILES8} select src, x // 2 x, y // 2 y, round(avg(v), 6) v from tiles8 group by all")
def tile_halved(spark, sf_dir):
    c = views.tiles8(spark, sf_dir).select("src", F.col("src").alias("ord"), F.lit(1).alias("band"), "x", "y", "v", F.lit(True).alias("valid"))
    return rounded(tiles.unpack(tiles.halve(tiles.pack(c, 8), 8), 8).select("src", "x", "y", "v"), "v")


@query("""with recursive s as (select p_partkey k, 0 l, p_partkey * 13 + 1 w, p_partkey * 7 + 1 h from part union all
  select k, l + 1, (w + 1) // 2, (h + 1) // 2 from s where greatest(w, h) > 512) select k, l "level", w, h from s where l > 0""")
def overview_sizes(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.explode(rects.overview_sizes(F.col("p_partkey") * 13 + 1, F.col("p_partkey") * 7 + 1)).alias("s"))
    return p.select("k", "s.level", "s.w", "s.h")


# planning


@query("""with t as (select c_custkey k, c_custkey % 360 - 180 west, c_nationkey * 7 % 180 - 90 south from customer),
  b as (select -180 + cast(floor((west + 180) / 20) as bigint) * 20 west, -180 + cast(floor((south + 180) / 20) as bigint) * 20 o, count(distinct k) tiles from t group by all),
  c as (select west, greatest(-90, o) south, west + 20 east, least(90, o + 20) north, tiles from b)
  select 'BLOCK_' || case when south >= 0 then 'N' else 'S' end || lpad(cast(abs(south) as varchar), 2, '0') || case when west >= 0 then 'E' else 'W' end || lpad(cast(abs(west) as varchar), 3, '0')
    || '_' || case when north - 1 >= 0 then 'N' else 'S' end || lpad(cast(abs(north - 1) as varchar), 2, '0') || case when east - 1 >= 0 then 'E' else 'W' end || lpad(cast(abs(east - 1) as varchar), 3, '0') "block",
    west, south, east, north, (west + 180) * 10 x, (90 - north) * 10 y, (east - west) * 10 + 1 w, (north - south) * 10 + 1 h, tiles, tiles >= 3 eligible from c""")
def block_plan(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    t = c.select(F.col("c_custkey").alias("path"), (F.col("c_custkey") % 360 - 180).alias("west"), (F.col("c_nationkey").cast("long") * 7 % 180 - 90).alias("south"))
    made = planning.tile_blocks(t, 20, 3, 10)
    return longs(made, "west", "south", "east", "north", "x", "y", "w", "h", "tiles")


@query(f"""with {views.RECTS} select a.ord a, b.ord b, greatest(a.x, b.x) x, greatest(a.y, b.y) y, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) w,
  least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) h from rects a join rects b on a.ord < b.ord and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h""")
def rect_overlaps(spark, sf_dir):
    return planning.overlap_pairs(views.rects(spark, sf_dir), "ord")


@query(f"with {views.PARTS} select distinct block, source, x, y, w, h from parts")
def block_contributors(spark, sf_dir):
    return planning.contributors(views.squares(spark, sf_dir), views.rects(spark, sf_dir))


@query(f"with {views.PARTS} select block, area from unions")
def rect_union_area(spark, sf_dir):
    parts = planning.contributors(views.squares(spark, sf_dir), views.rects(spark, sf_dir))
    return longs(planning.union_area(parts, ["block"]), "area")


_CUT = 12


@query(f"""with {views.RECTS}, far as (select min(x) fx, min(y) fy, max(x + w) fr, max(y + h) fb from rects),
  c as (select x - fx x, y - fy y, w, h from rects, far where w > 0 and h > 0),
  s as (select kx, ky, min(greatest(x, kx * {_CUT})) l, min(greatest(y, ky * {_CUT})) t, max(least(x + w, kx * {_CUT} + {_CUT})) r, max(least(y + h, ky * {_CUT} + {_CUT})) b
    from c, unnest(range(x // {_CUT}, (x + w - 1) // {_CUT} + 1)) a(kx), unnest(range(y // {_CUT}, (y + h - 1) // {_CUT} + 1)) e(ky) group by kx, ky),
  n as (select cast(2 * ceil(log2(ceil(greatest(fr - fx, fb - fy) / {_CUT}.0))) as bigint) n from far),
  u as (select s.*, v.v v, kx >> cast((v.v + 1) // 2 as bigint) cx, ky >> cast(v.v // 2 as bigint) cy from s, n, unnest(range(n.n + 1)) v(v)),
  f as (select v, cx, cy, min(l) l, min(t) t, max(r) r, max(b) b from u group by v, cx, cy having v = 0 or (max(r) - min(l)) * (max(b) - min(t)) <= {(8 * _CUT) ** 2}),
  p as (select kx, ky, max(v) v from u semi join f using (v, cx, cy) group by kx, ky),
  o as (select distinct f.l, f.t, f.r, f.b from p join u using (kx, ky, v) join f using (v, cx, cy))
  select row_number() over (order by t, l) - 1 ord, l + fx x, t + fy y, r - l w, b - t h from o, far""")
def output_regions(spark, sf_dir):
    return longs(planning.regions(views.rects(spark, sf_dir), (8 * _CUT) ** 2), "ord", "x", "y", "w", "h")


@query(f"with {views.RECTS} select ord, w * h area, w * h covered from rects")
def coverage_check(spark, sf_dir):
    return longs(planning.coverage(views.rects(spark, sf_dir), views.squares(spark, sf_dir).withColumnRenamed("block", "ord")), "area", "covered")


@query(f"""with {views.PARTS}, d as (select distinct block, source, w, h from parts), n as (select block, count(*) seen, cast(sum(w * h * (1 + source % 9)) as bigint) s from d group by block),
  e as (select n.block, s source_bytes, cast(s + ceil(greatest(0, 4096 - area) / 262144.0) * 1024 + 16 + 65536 as bigint) output_bytes, greatest(65536, seen * 1024) temporary_bytes
    from n join unions using (block))
  select block, source_bytes, output_bytes, temporary_bytes, cast(ceil((output_bytes + temporary_bytes) * cast(1.1 as double)) as bigint) reserved_bytes from e""")
def storage_estimates(spark, sf_dir):
    r = views.rects(spark, sf_dir)
    sources = r.select("ord", (F.col("w") * F.col("h") * (1 + F.col("ord") % 9)).alias("base_bytes"), (F.col("w") * F.col("h")).alias("pixels"))
    blocks = views.squares(spark, sf_dir)
    return longs(planning.storage_estimate(blocks, planning.contributors(blocks, r), sources), "source_bytes", "output_bytes", "temporary_bytes", "reserved_bytes")


# serving benchmarks and request logs


_LINEAR = "round(quantile_cont(seconds, 0.5), 6) p50, round(quantile_cont(seconds, 0.95), 6) p95, round(quantile_cont(seconds, 0.99), 6) p99"


@query(f"with {views.REQUESTS} select operation, {_LINEAR} from requests group by operation")
def latency_percentiles(spark, sf_dir):
    return rounded(benchmark.latencies(views.requests(spark, sf_dir), ["operation"]), "p50", "p95", "p99")


@query(f"with {views.REQUESTS} select operation, quantile_disc(seconds, 0.5) p50, quantile_disc(seconds, 0.95) p95, quantile_disc(seconds, 0.99) p99 from requests group by operation")
def usage_percentiles(spark, sf_dir):
    return benchmark.nearest_ranks(views.requests(spark, sf_dir), ["operation"])


@query(f"""with {views.REQUESTS} select cast("at" as date) "day", count(*) requests, round(count(*) / 86400, 9) requests_per_second, cast(count(*) filter (not ok) as bigint) errors,
  round((count(*) filter (not ok)) / count(*), 9) error_fraction, cast(sum(coalesce(bytes, 0)) as bigint) response_bytes, cast(count(*) filter (cache = 'HIT') as bigint) hits,
  round((count(*) filter (cache = 'HIT')) / count(*), 9) hit_fraction, count(distinct "user") users, {_LINEAR} from requests group by 1""")
def run_summary(spark, sf_dir):
    r = views.requests(spark, sf_dir).withColumn("day", F.to_date("at"))
    made = benchmark.run_summary(r, ["day"], 86400.0)
    return rounded(rounded(made, "p50", "p95", "p99"), "requests_per_second", "error_fraction", "hit_fraction", digits=9)


@query(f"""with {views.REQUESTS}, c as (select "user", cache, count(*) n from requests group by all)
  select "user", string_agg(cache || '=' || n, ',' order by cache) cache_counts from c group by "user" """)
def cache_mix(spark, sf_dir):
    made = benchmark.cache_counts(views.requests(spark, sf_dir), ["user"])
    return made.select("user", F.array_join(F.transform(F.array_sort(F.map_entries("cache_counts")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("cache_counts"))


@query(f"""with {views.REQUESTS}, s as (select "user", count(*) requests, count(*) filter (ok) views, (count(*) filter (cache = 'HIT')) / count(*) hit_fraction,
    count(*) filter (not ok) exhausted, case when "user" % 2 = 0 then 'hit' else 'miss' end scenario, avg(seconds) / 1000 lag_p95, 0.0 cpu_p95 from requests group by "user")
  select "user", concat_ws(',', case when requests = 0 or views = 0 then 'no_network_samples' end, case when exhausted > 0 then 'finite_miss_trace_exhausted' end,
    case when scenario = 'hit' and hit_fraction < 0.99 then 'cache_hit_contract_failed' end, case when lag_p95 > 0.05 then 'generator_saturation' end) issues,
    not (requests = 0 or views = 0 or exhausted > 0 or (scenario = 'hit' and hit_fraction < 0.99) or lag_p95 > 0.05) valid from s""")
def validity_issues(spark, sf_dir):
    r = views.requests(spark, sf_dir)
    s = r.groupBy("user").agg(
        F.count("*").alias("requests"), F.count_if("ok").alias("views"), (F.count_if(F.col("cache") == "HIT") / F.count("*")).alias("hit_fraction"), F.count_if(~F.col("ok")).alias("exhausted"),
        (F.avg("seconds") / 1000).alias("lag_p95"), F.lit(0.0).alias("cpu_p95"),
    )
    s = s.withColumn("scenario", F.when(F.col("user") % 2 == 0, "hit").otherwise("miss"))
    return benchmark.validity_issues(s).select("user", F.array_join("issues", ",").alias("issues"), "valid")


@query(f"""with {views.REQUESTS} select "user", event_id, round(seconds - lag(seconds) over (partition by "user" order by "at", event_id), 6) delta from requests""")
def telemetry_deltas(spark, sf_dir):
    made = benchmark.deltas(views.requests(spark, sf_dir), ["user"], ["at", "event_id"], "seconds")
    return rounded(made.select("user", "event_id", "delta"), "delta")


@query(f"""with {views.REQUESTS}, s as (select "user", cast(event_id as double) m, seconds * 1e6 u, seconds * 1e3 t, bytes * 1000 b from requests where ok),
  d as (select *, m - lag(m) over w dt, u - lag(u) over w du, t - lag(t) over w dd from s window w as (partition by "user" order by m))
  select "user", count(*) samples, round(quantile_cont(case when dt > 0 then du / 1e6 / dt / 2 end, 0.95), 6) cpu_utilization_p95,
    round(sum(case when dt > 0 then greatest(0, coalesce(dd, 0)) / 1e6 end), 6) cpu_throttled_seconds, max(b) peak_memory_bytes, round(max(b) / 1073741824.0 / 4, 9) memory_utilization_peak,
    arg_max(b, m) - arg_min(b, m) io_delta from d group by "user" """)
def telemetry_summary(spark, sf_dir):
    r = views.requests(spark, sf_dir).where("ok")
    b = F.col("bytes") * 1000
    s = r.select(
        "user", F.lit("measurement").alias("phase"), F.col("event_id").cast("double").alias("monotonic"), (F.col("seconds") * 1e6).alias("usage_usec"), (F.col("seconds") * 1e3).alias("throttled_usec"),
        b.alias("memory_bytes"), b.alias("rss_bytes"), b.alias("heap_bytes"), b.alias("file_bytes"), b.alias("cache_bytes"), b.alias("available_bytes"), b.alias("io_bytes"), F.col("seconds").alias("gc_seconds"),
    )
    made = benchmark.telemetry_summary(s, ["user"], 2.0, 4.0).select("user", "samples", "cpu_utilization_p95", "cpu_throttled_seconds", "peak_memory_bytes", "memory_utilization_peak", "io_delta")
    return rounded(rounded(made, "cpu_utilization_p95", "cpu_throttled_seconds"), "memory_utilization_peak", digits=9)


_REQUIRED = [(s, n) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY") for n in (0, 1)]


@query(f"with {views.RUNS}" + """, f as (select * from runs where valid), c as (select variant from f group by variant having count(distinct scenario || repetition) = 10),
  s as (select lossless, variant, avg(error_fraction) e, avg(p95) p from f semi join c using (variant) group by all)
  select lossless, variant, round(e, 10) error, round(p, 10) p95 from (select *, row_number() over (partition by lossless order by e, p, variant) r from s) where r = 1""")
def variant_shortlist(spark, sf_dir):
    return rounded(benchmark.shortlist(views.runs(spark, sf_dir), _REQUIRED), "error", "p95", digits=10)


_PROFILE = f"""with {views.RUNS}, one as (select cast(cast(variant as integer) % 5 as varchar) variant, profile, scenario, repetition, count(*) filter (not valid) <= count(*) / 2 valid, max(p95) p95, avg(error_fraction) e from runs group by all),
  w as (select variant, profile, unnest(list_filter([case when not valid then 'invalid, unfinished or synthetic evidence' end, case when p95 >= 5 then 'view latency target' end,
    case when e >= 0.5 then 'view error target' end, ''], lambda x: x is not null)) why, scenario, repetition from one),
  m as (select variant, profile, count(*) n from one group by all),
  q as (select variant, profile, why from w where why <> '' union select variant, profile, 'incomplete scenario/repetition matrix' from m where n <> 10),
  d as (select m.variant, m.profile, coalesce((select string_agg(why, ';' order by why) from q where q.variant = m.variant and q.profile = m.profile), '') reasons from m)"""


def _decisions(spark, sf_dir) -> DataFrame:
    r = views.runs(spark, sf_dir).withColumn("variant", (F.col("variant").cast("int") % 5).cast("string"))
    one = r.groupBy("variant", "profile", "scenario", "repetition").agg((F.count_if(~F.col("valid")) <= F.count("*") / 2).alias("valid"), F.max("p95").alias("p95"), F.avg("error_fraction").alias("error_fraction"))
    one = one.withColumns({"cpus": F.col("profile") + 1, "memory_gib": F.lit(4), "cpu_p95": F.lit(0.5), "memory_peak": F.lit(0.5)})
    return benchmark.qualify(one, _REQUIRED, benchmark.ACCEPTANCE | {"max_view_error_fraction": 0.5})


@query(_PROFILE + " select variant, profile, reasons, reasons = '' qualifies from d")
def profile_qualification(spark, sf_dir):
    return _decisions(spark, sf_dir).select("variant", "profile", F.array_join("reasons", ";").alias("reasons"), "qualifies")


@query(_PROFILE + " select variant, cast(min(profile) as integer) profile from d where reasons = '' group by variant")
def smallest_profiles(spark, sf_dir):
    return benchmark.smallest_profiles(_decisions(spark, sf_dir)).select("variant", "profile")


@query(f"with {views.RUNS} select variant, scenario, profile, round(avg(p95) filter (valid), 10) mean_p95, cast(count(*) filter (valid) as bigint) valid_runs, count(*) runs from runs group by all")
def repeated_run_means(spark, sf_dir):
    return rounded(benchmark.repeated_means(views.runs(spark, sf_dir), ["variant", "scenario", "profile"]), "mean_p95", digits=10)


def _uniform(*parts: str) -> str:
    return f"(cast('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) as bigint) / 4294967296.0::double)"


@query(f"""with {views.RUNS}, v as (select concat_ws('/', variant, scenario, profile) cell, p95 from runs),
  r as (select cell, p95, row_number() over (partition by cell order by p95) - 1 i, count(*) over (partition by cell) n from v),
  d as (select cell, k.k k, cast(floor({_uniform("1234", "cell", "k.k", "j.j")} * n) as bigint) i from (select distinct cell, n from r where n > 1), range(200) k(k), unnest(range(n)) j(j)),
  m as (select cell, k, avg(p95) mean from d join r using (cell, i) group by all)
  select cell, count(*) n, round(any_value(low), 10) low, round(any_value(high), 10) high from v left join (select cell, quantile_cont(mean, 0.025) low, quantile_cont(mean, 0.975) high from m group by cell) using (cell) group by cell""")
def bootstrap_intervals(spark, sf_dir):
    runs = views.runs(spark, sf_dir).withColumn("cell", F.concat_ws("/", "variant", "scenario", F.col("profile").cast("string")))
    return rounded(benchmark.bootstrap(runs, "cell", "p95", resamples=200), "low", "high", digits=10)


_SPOTS, _ZOOMS, _EXTENT, _VIEW = [("north", 500000.0, 6200000.0), ("east", 1900000.0, 5600000.0), ("south", 900000.0, 4600000.0)], (4, 12), (-200000.0, 4000000.0, 2600000.0, 7000000.0), (1280, 720)


def _trace_sql() -> str:
    half = mercator.HALF
    fit = max(0, *[math.ceil(math.log2(n * 2 * half / (256 * span))) for n, span in ((_VIEW[0], _EXTENT[2] - _EXTENT[0]), (_VIEW[1], _EXTENT[3] - _EXTENT[1]))])
    spots = ", ".join(f"{{'region': '{n}', 'x': {x!r}::double, 'y': {y!r}::double}}" for n, x, y in _SPOTS)
    u = lambda view, what: _uniform("7", "u", view, f"'{what}'")
    metre = f"({2 * half / 256!r}::double / power(2.0::double, z))"
    inside = lambda v, n, a, b: f"greatest({a!r}::double + {metre} * {n / 2!r}, least({b!r}::double - {metre} * {n / 2!r}, {v}))"
    kept = f"{{'zoom': z, 'x': {inside('x', _VIEW[0], _EXTENT[0], _EXTENT[2])}, 'y': {inside('y', _VIEW[1], _EXTENT[1], _EXTENT[3])}, 'region': region}}"
    place = lambda view: f"([{spots}])[cast(floor({u(view, 'region')} * {len(_SPOTS)}) as integer) + 1]"
    last = f"({2 * half / 256!r}::double / power(2.0::double, last.zoom))"
    return f"""with recursive t as (
  select u, -1 i, 'start' a, [{kept}] seen from (select c_custkey u, greatest({fit}, {_ZOOMS[0]} + cast(floor({_uniform("7", "c_custkey", "-1", "'zoom'")} * {_ZOOMS[1] - _ZOOMS[0] + 1}) as integer)) z, p.x x, p.y y, p.region region
    from (select c_custkey, {place("-1").replace("u, -1", "c_custkey, -1")} p from customer))
  union all select u, i, a, seen || [{kept}] from (
    select u, i, a, seen, greatest({fit}, case a when 'zoom' then greatest({_ZOOMS[0]}, least({_ZOOMS[1]}, last.zoom + case when {u("i", "turn")} < 0.5 then -1 else 1 end)) when 'revisit' then back.zoom else last.zoom end) z,
      case a when 'pan' then last.x + case when {u("i", "across")} < 0.5 then -1.0::double else 1.0::double end * {last} * {0.6 * _VIEW[0]!r}::double when 'zoom' then last.x when 'revisit' then back.x else there.x end x,
      case a when 'pan' then last.y + (floor({u("i", "up")} * 3) - 1) * {last} * {0.4 * _VIEW[1]!r}::double when 'zoom' then last.y when 'revisit' then back.y else there.y end y,
      case a when 'revisit' then back.region when 'relocate' then there.region else last.region end region
    from (select u, i, seen, seen[-1] last, case when p < 0.55 then 'pan' when p < 0.8 then 'zoom' when p < 0.9 then 'revisit' else 'relocate' end a, {place("i")} there,
        seen[-(cast(floor({u("i", "back")} * greatest(1, least(i, 8))) as integer) + 1)] back
      from (select u, i + 1 i, seen, {u("i + 1", "action")} p from t where i < 19))))
select u "user", cast(i as integer) "view", a "action", cast(seen[-1].zoom as integer) zoom, round(seen[-1].x, 3) x, round(seen[-1].y, 3) y, seen[-1].region region, round(0.5 + {u("i", "think")} * 2.0, 9) think from t where i >= 0"""


@query(_trace_sql())
def trace_views(spark, sf_dir):
    users = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"))
    made = benchmark.make_traces(users, _SPOTS, _ZOOMS, 20, _EXTENT, _VIEW)
    return rounded(rounded(made, "x", "y", digits=3), "think", digits=9)


@query("""select n_name variant, r_name profile, s scenario, u users, cast(k as integer) repetition, substr(sha256(n_name || '|' || r_name || '|' || s || '|' || u || '|' || k), 1, 16) id
  from nation, region, (select unnest(['hit', 'miss', 'wms']) s), (select unnest([1, 10]) u), range(3) t(k)""")
def job_matrix(spark, sf_dir):
    v = views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("variant"))
    return benchmark.job_matrix(v, views.table(spark, sf_dir, "region").select(F.col("r_name").alias("profile")), ["hit", "miss", "wms"], 3, [1, 10])


@query("""with w as (select o_custkey % 50 x, o_orderkey % 40 y, count(*) weight from orders group by all), s as (select *, x * 7919 % 1009 k, sum(weight) over () t from w),
  r as (select *, coalesce(sum(weight) over (order by k, x, y rows between unbounded preceding and 1 preceding), 0) b from s)
  select x, y, weight, k, cast(b as bigint) "before" from r where b < t * 0.3""")
def seed_prefix(spark, sf_dir):
    w = views.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("x"), (F.col("o_orderkey") % 40).alias("y")).agg(F.count("*").alias("weight"))
    return benchmark.seed_prefix(w.withColumn("k", F.col("x") * 7919 % 1009), ["k", "x", "y"], 0.3)


@query(f"""with {views.REQUESTS}, v as (select "user", event_id, ok, range(event_id % 13, event_id % 13 + 6) t from requests),
  h as (select *, coalesce(case when lag(ok) over w then lag(t) over w end, []) p from v window w as (partition by "user" order by event_id))
  select "user", event_id, len(list_filter(t, lambda x: not list_contains(p, x))) needed, len(list_filter(t, lambda x: list_contains(p, x))) reused from h""")
def tile_reuse(spark, sf_dir):
    v = views.requests(spark, sf_dir).select("user", F.col("event_id").alias("view"), "ok", F.sequence(F.col("event_id") % 13, F.col("event_id") % 13 + 5).alias("tiles"))
    made = benchmark.tile_reuse(v)
    return made.select("user", F.col("view").alias("event_id"), F.size("needed").cast("long").alias("needed"), F.size("reused").cast("long").alias("reused"))


@query(f"""with {views.REQUESTS} select operation object, count(*) requests, cast(sum(bytes) as bigint) bytes, bool_and(event_id % 100 <> 0) all_ranged, cast(count(*) filter (event_id % 40 = 0) as bigint) missing
  from requests where "user" % 3 <> 0 group by operation""")
def audit_rollup(spark, sf_dir):
    r = views.requests(spark, sf_dir)
    e = r.select(
        F.when(F.col("user") % 3 == 0, "curl/8").otherwise("aws-sdk-java/2.1").alias("user_agent"), F.lit("GetObject").alias("api"), F.col("operation").alias("object"), F.col("bytes").alias("content_length"),
        F.when(F.col("event_id") % 100 != 0, "bytes=0-9").alias("range"), F.when(F.col("event_id") % 40 == 0, 404).otherwise(206).alias("status"),
    )
    return benchmark.audit_rollup(e)


_FLAGS = f"""with {views.REQUESTS}, f as (select event_id, "at", operation, seconds * 100 >= 5000 slow, not ok or event_id % 50 = 0 failed from requests)"""


def _flagged(spark, sf_dir) -> DataFrame:
    r = views.requests(spark, sf_dir)
    return benchmark.request_flags(r.withColumn("total_ms", F.col("seconds") * 100).withColumn("status", F.when(F.col("event_id") % 50 == 0, 500).otherwise(200)))


@query(_FLAGS + " select event_id, slow, failed, slow or failed flagged from f")
def request_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).select("event_id", "slow", "failed", "flagged")


@query(_FLAGS + """ select date_trunc('hour', "at") "hour", operation, count(*) requests, cast(count(*) filter (slow or failed) as bigint) flagged from f group by 1, 2""")
def requests_by_hour(spark, sf_dir):
    return _flagged(spark, sf_dir).groupBy(F.expr("cast(date_trunc('HOUR', at) as timestamp_ntz)").alias("hour"), "operation").agg(F.count("*").alias("requests"), F.count_if("flagged").alias("flagged"))


# map tiles, scenes, metadata


_HALF = mercator.HALF


@query(f"""with {views.PLACES} select id, z, round({_HALF!r} * lon / 180, 4) mx, round({_HALF!r} * ln(tan(pi() / 4 + radians(lat) / 2)) / pi(), 4) my,
  cast(floor((lon + 180) / 360 * pow(2, z)) as bigint) tx, cast(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * pow(2, z)) as bigint) ty,
  cast(pow(2, z) as bigint) - 1 - cast(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * pow(2, z)) as bigint) flipped from places""")
def mercator_tiles(spark, sf_dir):
    p = views.places(spark, sf_dir)
    at, tile = mercator.forward(F.col("lon"), F.col("lat")), mercator.tile_of(F.col("lon"), F.col("lat"), F.col("z"))
    return p.select("id", "z", F.round(at["x"], 4).alias("mx"), F.round(at["y"], 4).alias("my"), tile["x"].alias("tx"), tile["y"].alias("ty"), mercator.flipped_row(F.col("z"), tile["y"]).alias("flipped"))


@query(f"""with {views.PLACES}, t as (select z, cast(floor((lon + 180) / 360 * pow(2, z)) as bigint) x, cast(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * pow(2, z)) as bigint) y from places)
  select z, x // 4 x, y // 4 y, count(*) weight from t group by all""")
def metatile_weights(spark, sf_dir):
    p = views.places(spark, sf_dir)
    tile = mercator.tile_of(F.col("lon"), F.col("lat"), F.col("z"))
    return benchmark.metatile_weights(p.select(F.array(F.struct("z", tile["x"].alias("x"), tile["y"].alias("y"))).alias("tiles")))


@query(f"""with {views.PLACES}, b as (select id, z, {_HALF!r} * lon / 180 mx, {_HALF!r} * ln(tan(pi() / 4 + radians(lat) / 2)) / pi() my, 2 * {_HALF!r} / pow(2, z) w from places)
  select id, cast((floor((mx + w * 2 + {_HALF!r} - 1e-6) / w) - floor((mx - w * 2 + {_HALF!r}) / w) + 1) * (floor(({_HALF!r} - (my - w * 1.5) - 1e-6) / w) - floor(({_HALF!r} - (my + w * 1.5)) / w) + 1) as bigint) tiles from b""")
def view_tile_counts(spark, sf_dir):
    p = views.places(spark, sf_dir)
    box = mercator.view_bbox(F.col("lon"), F.col("lat"), F.col("z"), 1024, 768)
    return p.select("id", F.size(mercator.view_tiles(F.col("z"), box["west"], box["south"], box["east"], box["north"])).cast("long").alias("tiles"))


@query("""with p as (select p_brand tile_id, p_partkey id, cast(p_size as double) cloud_cover, floor(p_retailprice) area from part where p_partkey % 5 <> 0),
  m as (select *, max(area) over (partition by tile_id) t from p)
  select tile_id, id, cloud_cover, area from (select *, row_number() over (partition by tile_id order by cloud_cover, id desc) r from m where area >= t * cast(0.999 as double)) where r = 1""")
def best_scenes(spark, sf_dir):
    return scenes.best_per_tile(views.products(spark, sf_dir)).select("tile_id", "id", "cloud_cover", "area")


@query()
def scene_cover(spark, sf_dir):
    p = views.table(spark, sf_dir, "supplier")
    west, south = F.col("s_suppkey") * 37 % 90 * 1.0, F.col("s_suppkey") * 53 % 90 * 1.0
    boxes = p.select(F.col("s_suppkey").cast("string").alias("id"), (F.col("s_suppkey") % 7).cast("double").alias("cloud_cover"), west.alias("west"), south.alias("south"), (west + 20).alias("east"), (south + 20).alias("north"))
    return scenes.greedy_cover(boxes, (0.0, 0.0, 100.0, 100.0))


@query("""with f as (select n_regionkey region, unnest(range(250101, 250101 + 3 + n_regionkey)) d from nation)
  select cast(max(d) as varchar) date from (select d from f group by d having count(distinct region) = (select count(distinct n_regionkey) from nation))""")
def common_snapshot(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.explode(F.sequence(F.lit(250101), 250103 + F.col("n_regionkey"))).alias("d"))
    return benchmark.common_snapshot(n.select("region", F.concat(F.lit("area-"), F.col("d").cast("string"), F.lit(".osm.pbf")).alias("name")))


@query("""select p_partkey, cast(cast(p_size as bigint) * case p_partkey % 4 when 0 then 1000000000 when 1 then 1073741824 when 2 then 1 else 1000 end as bigint) bytes,
  lpad(cast(p_size * 100 // 3600 as varchar), 2, '0') || ':' || lpad(cast(p_size * 100 // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(p_size * 100 % 60 as varchar), 2, '0') duration from part""")
def sizes_and_durations(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    unit = F.element_at(F.array(F.lit("GB"), F.lit("GiB"), F.lit(""), F.lit("kB")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select("p_partkey", text.size_bytes(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"), text.duration(F.col("p_size") * 100).alias("duration"))


@query(f"""with {views.PLACES} select id, 'http://maps/wmts?SERVICE=WMTS&VERSION=1.0.0&REQUEST=GetTile&LAYER=w%3Abase&STYLE=&FORMAT=image%2Fpng&TILEMATRIXSET=EPSG%3A900913&TILEMATRIX=EPSG%3A900913%3A'
  || z || '&TILEROW=' || id % 7 || '&TILECOL=' || id % 5 url from places""")
def tile_urls(spark, sf_dir):
    p = views.places(spark, sf_dir)
    return p.select("id", mercator.wmts_url("http://maps/wmts", F.lit("w:base"), "image/png", F.col("z"), F.col("id") % 5, F.col("id") % 7).alias("url"))


@query("""with b as (select s_suppkey k, s_acctbal v from supplier), a as (select s_suppkey k, case when s_suppkey % 10 = 0 then s_acctbal + 1 else s_acctbal end v from supplier where s_suppkey % 17 <> 0)
  select cast(coalesce(b.k, a.k) as varchar) path from b full join a on a.k = b.k where a.v is distinct from b.v""")
def changed_inputs(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier")
    row = lambda v: [F.col("s_suppkey").cast("string").alias("path"), F.lit(1).alias("size"), v.cast("string").alias("sha256")]
    v = F.col("s_acctbal")
    return planning.unchanged(s.select(*row(v)), s.where("s_suppkey % 17 <> 0").select(*row(F.when(F.col("s_suppkey") % 10 == 0, v + 1).otherwise(v))))


# sources, sinks and streams


@query(SQL["mosaic_last"])
def geotiff_round_trip(spark, sf_dir):
    """The mosaic, packed into tiles, written as GeoTIFF and read back."""
    geotiff.register(spark)
    made = _last(spark, sf_dir).select(F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("ord"), "band", "x", "y", "v", F.lit(True).alias("valid"))
    packed = tiles.pack(made, 32).select(F.lit("mosaic").alias("block"), "band", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), tiles.filled("samples", "valid", -9999.0).alias("samples"))
    path = scratch(spark)
    out = packed.repartition("block").sortWithinPartitions("block").write.format("geotiff").mode("append")
    out.options(path=path, edge=32, width=64, height=64, bands=7, dtype="float64", nodata="-9999", compression="zstd", predictor=3).save()
    return tiles.window_cells(spark.read.format("geotiff").load(path)).select("band", "x", "y", "v")


@query(f"""with {views.REQUESTS} select date_trunc('hour', "at") "start", operation, count(*) requests, cast(count(*) filter (not ok) as bigint) errors, round(avg(seconds), 6) mean_seconds from requests group by 1, 2""")
def stream_windows(spark, sf_dir):
    """Hourly windows of the requests, as a stream over the table's file."""
    source = spark.readStream.schema(views.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    rows = source.select(F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("seconds"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").alias("operation"))
    made = drained(windowed(rows), scratch(spark), "complete")
    return rounded(made.withColumn("start", F.col("start").cast("timestamp_ntz")), "mean_seconds")


@query(f"""with {views.PLACES}, t as (select z, cast(floor((lon + 180) / 360 * pow(2, z)) as bigint) x, cast(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * pow(2, z)) as bigint) y from places)
  select z, x // 4 x, y // 4 y, count(*) - 1 hits, cast(1 as bigint) misses from t group by all""")
def cache_hits(spark, sf_dir):
    p = views.places(spark, sf_dir)
    tile = mercator.tile_of(F.col("lon"), F.col("lat"), F.col("z"))
    return metatile_hits(p.select("z", tile["x"].alias("x"), tile["y"].alias("y")))
