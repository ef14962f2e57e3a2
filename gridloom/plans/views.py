"""Views of the driver's tables that give each operator family an input of its shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ORDER = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]


#: Values that each of the ordering columns has room for. Their product is below 10^38, which is a hundred thousand times scale factor 1.
_ROOM = {"l_suppkey": 10**10, "l_orderkey": 10**12, "l_linenumber": 10, "l_partkey": 10**11, "l_quantity": 100}


def _place() -> Column:
    """Supplier, order, line, part and quantity, which no two rows share, as one decimal in that order: aggregates by it stay in hash tables.

    A value beyond its column's room raises, as numbers of other rows would run into it.
    """
    out = None
    for name, room in _ROOM.items():
        value = F.when(F.col(name).between(0, room - 1), F.col(name).cast("long")).otherwise(F.raise_error(F.lit(f"{name} is beyond {room}")).cast("long"))
        digits = len(str(room - 1))
        out = value.cast(f"decimal({digits},0)") if out is None else out * F.lit(room).cast(f"decimal({digits + 1},0)") + value.cast(f"decimal({digits},0)")
    return out.cast("decimal(38,0)")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as samples of up to 64 by 64 cells in seven bands, one source per supplier."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_suppkey").alias("src"), _place().alias("ord"), F.col("l_linenumber").alias("band"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_orderkey") % 64).alias("y"),
        F.col("l_quantity").cast("double").alias("v"), (F.col("l_returnflag") != "N").alias("valid"),
    )


CELLS = f"""cells as (select l_suppkey src, row_number() over (order by {", ".join(_ORDER)}) ord, l_linenumber band, l_partkey % 64 x, l_orderkey % 64 y,
  cast(l_quantity as double) v, l_returnflag <> 'N' valid from lineitem)"""
MOSAIC = CELLS + """, mosaic as (select band, x, y, v from (select *, row_number() over (partition by band, x, y order by ord desc) r from cells where valid) where r = 1)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same samples as posts of tiles whose columns are 2, 3, 4 or 6 grid steps apart."""
    factor = F.element_at(F.array(*[F.lit(k) for k in (2, 3, 4, 6)]), (F.col("src") % 4 + 1).cast("int"))
    return cells(spark, sf_dir).withColumn("factor", factor)


POSTS = CELLS + ", posts as (select *, [2, 3, 4, 6][src % 4 + 1] factor from cells)"


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return t.select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("x"), (F.col("o_orderkey") % 997).alias("y"), (1 + F.col("o_orderkey") % 7).alias("w"), (1 + F.col("o_custkey") % 5).alias("h"))


RECTS = "rects as (select o_orderkey ord, o_custkey x, o_orderkey % 997 y, 1 + o_orderkey % 7 w, 1 + o_custkey % 5 h from orders)"


def squares(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    """The squares of a grid that any rectangle covers, as blocks (block, x, y, w, h)."""
    r = rects(spark, sf_dir)
    span = lambda a, n: F.sequence(F.floor(F.col(a) / size), F.floor((F.col(a) + F.col(n) - 1) / size))
    keys = r.select(F.explode(span("x", "w")).alias("kx"), "y", "h").select("kx", F.explode(span("y", "h")).alias("ky")).distinct()
    return keys.select((F.col("ky") * 100000 + F.col("kx")).alias("block"), (F.col("kx") * size).alias("x"), (F.col("ky") * size).alias("y"), F.lit(size).cast("long").alias("w"), F.lit(size).cast("long").alias("h"))


PARTS = RECTS + """, corners as (select distinct ord, x, y, w, h, cast(floor(cx / 64.0) as bigint) kx, cast(floor(cy / 64.0) as bigint) ky
  from (select *, unnest([x, x + w - 1]) cx from rects) a, unnest([a.y, a.y + a.h - 1]) b(cy)),
parts as (select ky * 100000 + kx block, ord source, greatest(x, kx * 64) x, greatest(y, ky * 64) y, least(x + w, kx * 64 + 64) - greatest(x, kx * 64) w,
  least(y + h, ky * 64 + 64) - greatest(y, ky * 64) h from corners),
slabs as (select block, e l, lead(e) over (partition by block order by e) r from (select distinct block, unnest([x, x + w]) e from parts)),
runs as (select p.block, s.l, s.r, p.y a, p.y + p.h b, max(p.y + p.h) over (partition by p.block, s.l order by p.y, p.y + p.h rows between unbounded preceding and 1 preceding) t
  from (select distinct block, x, y, w, h from parts) p join slabs s on p.block = s.block and s.l >= p.x and s.l < p.x + p.w and s.r is not null),
unions as (select block, cast(sum((r - l) * greatest(0, b - greatest(a, coalesce(t, a)))) as bigint) area from runs group by block)"""


def tiles8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 by 8 tile in reading order."""
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"), F.posexplode("embedding").alias("i", "v"))
    return t.select("src", (F.col("i") % 8).cast("long").alias("x"), F.floor(F.col("i") / 8).alias("y"), F.col("v").cast("double").alias("v"))


TILES8 = "tiles8 as (select vec_id src, cast((i - 1) % 8 as bigint) x, cast((i - 1) // 8 as bigint) y, cast(embedding[i] as double) v from embeddings, unnest(range(1, 65)) r(i))"


def _cache(kind: Column) -> Column:
    return F.when(kind == "view", "HIT").when(kind == "click", "MISS").otherwise("BYPASS")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return t.select(
        "event_id", F.col("user_id").alias("user"), F.col("ts").alias("at"), F.col("value").alias("seconds"), (F.col("event_type") != "error").alias("ok"), _cache(F.col("event_type")).alias("cache"),
        F.get_json_object("props", "$.k").cast("long").alias("bytes"), F.col("event_type").alias("operation"),
    )


REQUESTS = """requests as (select event_id, user_id "user", ts as "at", value as seconds, event_type <> 'error' ok,
  case event_type when 'view' then 'HIT' when 'click' then 'MISS' else 'BYPASS' end cache, cast(json_extract_string(props, '$.k') as bigint) bytes, event_type operation from events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a run of a variant (nation), scenario (market segment) and repetition."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max("o_totalprice").alias("top"), F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("bad")
    )
    c = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    return c.select(
        F.col("c_nationkey").cast("string").alias("variant"), (F.col("c_nationkey") % 2 == 0).alias("lossless"), F.col("c_mktsegment").alias("scenario"), (F.col("c_custkey") % 2).cast("int").alias("repetition"),
        (F.col("c_acctbal") > 0).alias("valid"), (F.col("bad") / F.col("n")).alias("error_fraction"), (F.col("top") / 100000).alias("p95"), (F.col("c_custkey") % 3).cast("int").alias("profile"), "c_custkey",
    )


RUNS = """runs as (select cast(c_nationkey as varchar) variant, c_nationkey % 2 = 0 lossless, c_mktsegment scenario, cast(c_custkey % 2 as integer) repetition, c_acctbal > 0 valid,
  bad / n error_fraction, top / 100000 p95, cast(c_custkey % 3 as integer) profile, c_custkey from customer join
  (select o_custkey, max(o_totalprice) top, count(*) n, count(*) filter (o_orderstatus = 'F') bad from orders group by o_custkey) on c_custkey = o_custkey)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places: longitude and latitude from the key, inside the projection's limits."""
    t = table(spark, sf_dir, "customer")
    return t.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 3600 / 10 - 180).alias("lon"), (F.col("c_custkey") * 53 % 1600 / 10 - 80).alias("lat"), (F.col("c_nationkey") % 12 + 3).cast("int").alias("z"))


PLACES = "places as (select c_custkey id, c_custkey * 37 % 3600 / 10 - 180 lon, c_custkey * 53 % 1600 / 10 - 80 lat, cast(c_nationkey % 12 + 3 as integer) z from customer)"


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    return t.select(
        F.col("p_brand").alias("tile_id"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("cloud_cover"), F.expr("timestamp_seconds(1700000000 + p_partkey * 3600)").alias("acquired"),
        F.floor(F.col("p_retailprice")).cast("double").alias("area"), (F.col("p_partkey") % 5 != 0).alias("online"),
    )
