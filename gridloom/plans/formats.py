"""Registered queries over files that Spark makes of the tables: rasters, mosaics' texts, logs, vector tiles and styles, with their SQL."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import projection
from gridloom.functions.shared import scratch, spread, written
from gridloom.operators import planning, tiles
from gridloom.operators import windows as rasters_
from gridloom.plans import jobs, views
from gridloom.plans.queries import longs, query, rounded
from gridloom.sources import dted, files, geotiff, shapefile, sqlite, telemetry, vector, vrt

# rasters

#: Five rasters of 64 by 64 cells: of each the largest sample of a place.
_LAYERS = """layers as (select l_suppkey % 5 s, l_partkey % 64 x, l_orderkey % 64 y, cast(max(l_quantity) as bigint) v from lineitem where l_returnflag <> 'N' group by all)"""


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    return t.groupBy((F.col("l_suppkey") % 5).alias("src"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_orderkey") % 64).alias("y")).agg(F.max("l_quantity").cast("double").alias("v"))


def _written(spark: SparkSession, sf_dir: str, dtype: str = "int16", nodata: str = "-1", **options) -> str:
    """The five as files s0.tif to s4.tif of a new folder."""
    geotiff.register(spark)
    cells = _layers(spark, sf_dir).select("src", F.col("src").alias("ord"), F.lit(1).alias("band"), "x", "y", "v", F.lit(True).alias("valid"))
    packed = tiles.pack(cells, 32).select(F.concat(F.lit("s"), "src").alias("block"), "band", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), tiles.filled("samples", "valid", float(nodata)).alias("samples"))
    path = scratch(spark)
    made = {"path": path, "edge": 32, "width": 64, "height": 64, "bands": 1, "dtype": dtype, "nodata": nodata, "crs": "EPSG:3857", "grid": "1000,10,0,2000,0,-10"}
    packed.repartition("block").sortWithinPartitions("block").write.format("geotiff").mode("append").options(**made, **options).save()
    return path


@query(f"with {_LAYERS}, r as (select *, row_number() over (partition by x, y order by s desc) r from layers) select x, y, v from r where r = 1")
def merged_rasters(spark, sf_dir):
    """The rasters merged into verified blocks that state and resumption know, and read again."""
    path, out = _written(spark, sf_dir, compression="zstd", predictor=2), scratch(spark)
    jobs.merge(spark, path, out, "last", edge=16, block_tiles=3, predictor=2, resume=True)
    meta = spark.read.format("geotiff").option("mode", "metadata").load(out).select("path", F.rint((F.col("c") - 1000) / 10).cast("long").alias("left"), F.rint((2000 - F.col("f")) / 10).cast("long").alias("top"))
    cells = tiles.window_cells(spark.read.format("geotiff").load(out)).join(meta, "path")
    return longs(cells.select((F.col("x") + F.col("left")).alias("x"), (F.col("y") + F.col("top")).alias("y"), "v"), "v")


@query(f"""with {_LAYERS}, o as (select *, first_value(s) over w f, first_value(v) over w fv from layers window w as (partition by x, y order by s)),
  d as (select f, s, y, x, row_number() over (partition by f, s order by y, x) r, count(*) over (partition by f, s) n from o where s > f and v <> fv)
  select f "first", s "second", n, y, x from d where r = 1""")
def raster_conflicts(spark, sf_dir):
    path = _written(spark, sf_dir)
    read = spark.read.format("geotiff").option("samples", "stored").load(path).withColumn("ord", F.regexp_extract("path", r"s(\d+)\.tif$", 1).cast("long"))
    return rasters_.conflicts(rasters_.parts(read, 16, "int16"), 16, "int16").select("first", "second", "n", "y", "x")


@query(f"with {_LAYERS} select s, x // 2 x, y // 2 y, round(avg(v), 6) v from layers group by all")
def overview_files(spark, sf_dir):
    """The first level of the overviews beside each raster."""
    path = _written(spark, sf_dir, "float64", overviews="none")
    jobs.external_overviews(spark, path, "average", least=16, edge=16)
    made = None
    for k in range(5):
        store, folder = files.opened(path)
        if store.get_file_info(f"{folder}/s{k}.tif.ovr").is_file:
            level = tiles.window_cells(spark.read.format("geotiff").load(f"{path}/s{k}.tif.ovr")).select(F.lit(k).cast("long").alias("s"), "x", "y", "v")
            made = level if made is None else made.unionByName(level)
    return rounded(made, "v") if made is not None else spark.createDataFrame([], "s long, x long, y long, v double")


@query("""select 's' || n_nationkey as block, least(48, (select max(n_nationkey) from nation) * 48 + 40 - n_nationkey * 48) width, 30 height, 2 bands, 'uint16' as dtype, 7.0::double nodata, (500.0 + n_nationkey * 48 * 2.5)::double c, 900.0::double f,
  'zstd' compression, 16 tile_width, cast(2 * 2 * ceil(least(48, (select max(n_nationkey) from nation) * 48 + 40 - n_nationkey * 48) / 16) as integer) tiles, 2 levels, 'EPSG:32636' crs, false masked, true valid, false plain from nation""")
def raster_metadata(spark, sf_dir):
    """A file per nation, its header read alone: sizes, grid, layout, overviews and faults of structure."""
    geotiff.register(spark)
    n = views.table(spark, sf_dir, "nation").select("n_nationkey")
    most = n.agg(F.max("n_nationkey")).first()[0]
    cells = n.select(F.col("n_nationkey").alias("src"), F.explode(F.array(F.lit(1), F.lit(2))).alias("band"), F.explode(F.sequence(F.lit(0), F.lit(47))).alias("x")).select("src", F.col("src").alias("ord"), "band", "x", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("y"))
    cells = cells.withColumns({"v": (F.col("x") + F.col("y")).cast("double"), "valid": F.lit(True)})
    rows = tiles.pack(cells, 16).select(F.concat(F.lit("s"), "src").alias("block"), "band", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), "samples", (F.col("src") * 48).alias("left"), F.lit(0).cast("long").alias("top"))
    path = scratch(spark)
    rows.repartition("block").sortWithinPartitions("block").write.format("geotiff").mode("append").options(
        path=path, edge=16, width=48, height=30, total_width=most * 48 + 40, total_height=30, bands=2, dtype="uint16", nodata="7", crs="EPSG:32636", grid="500,2.5,0,900,0,-2.5", compression="zstd", overviews="nearest"
    ).save()
    meta = spark.read.format("geotiff").option("mode", "metadata").load(path)
    plain = jobs.without_overviews(spark, path).select("path", F.lit(True).alias("p"))
    meta = meta.join(jobs.structure(spark, path).select("path", "valid"), "path").join(plain, "path", "left")
    ints = [F.col(c).cast("int").alias(c) for c in ("width", "height")]
    return meta.select(F.regexp_extract("path", r"(s\d+)\.tif$", 1).alias("block"), *ints, "bands", "dtype", "nodata", "c", "f", "compression", "tile_width", "tiles", "levels", "crs", "masked", "valid", F.coalesce("p", F.lit(False)).alias("plain"))


# texts of mosaics

_SOURCES = """sources as (select cast(c_nationkey as bigint) block, row_number() over (partition by c_nationkey order by c_custkey) - 1 ordinal, 'in/' || c_custkey || '.tif' filename, c_custkey % 7 sx, c_custkey % 300 dx, c_custkey % 11 dy,
  1 + c_custkey % 40 w, 1 + c_custkey % 9 h, c_custkey % 2 = 0 skip, c_custkey % 3 = 0 mask from customer)"""


def _mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A VRT per nation over its customers, written as texts and read again."""
    from pyspark.sql import Window

    c, k = views.table(spark, sf_dir, "customer"), F.col("c_custkey")
    long = lambda v: v.cast("long")
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    x, y, w, h = long(k % 300), long(k % 11), long(1 + k % 40), long(1 + k % 9)
    parts = c.select(
        F.col("c_nationkey").alias("block"), place.alias("ordinal"), F.lit("ComplexSource").alias("kind"), F.concat(F.lit("/data/in/"), k.cast("string"), F.lit(".tif")).alias("path"),
        F.struct(long(k % 7).alias("x"), long(F.lit(0)).alias("y")).alias("src"), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")).alias("dst"), (k % 2 == 0).alias("skip_nodata"), (k % 3 == 0).alias("use_mask"),
        x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"),
    )
    zero = long(F.lit(0))
    grid = F.array(*[F.lit(v) for v in (5.0, 0.5, 0.0, 9.0, 0.0, -0.5)])
    blocks = c.select(F.col("c_nationkey").alias("block")).distinct().select("block", zero.alias("x"), zero.alias("y"), long(F.lit(400)).alias("w"), long(F.lit(30)).alias("h"), grid.alias("grid"))
    path = scratch(spark)
    texts = vrt.block_vrts(blocks, parts, "Int16", "-9999", "EPSG:4326", folder="/data")
    texts.repartition("block").write.partitionBy("block").text(path)
    return vrt.read(spark, path).withColumn("block", F.regexp_extract("vrt", r"block=(\d+)", 1).cast("long"))


@query(f"with {_SOURCES} select block, ordinal, filename, sx, dx, dy, w, h, mask, case when skip then '-9999' end nodata from sources")
def mosaic_sources(spark, sf_dir):
    r = _mosaics(spark, sf_dir)
    return longs(r.select("block", "ordinal", "filename", F.col("src.x").alias("sx"), F.col("dst.x").alias("dx"), F.col("dst.y").alias("dy"), F.col("src.w").alias("w"), F.col("src.h").alias("h"), F.col("use_mask").alias("mask"), "nodata"), "ordinal", "sx", "dx", "dy", "w", "h")


@query(f"with {_SOURCES} select block, filename from sources where cast(filename[4:-5] as bigint) % 5 = 0")
def missing_sources(spark, sf_dir):
    there = views.table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.concat(F.lit("in/"), F.col("c_custkey").cast("string"), F.lit(".tif")).alias("path"))
    read = _mosaics(spark, sf_dir)
    return vrt.missing(read.withColumn("path", F.col("filename")), there).select("block", "filename")


@query("""with b as (select s_suppkey k, '<SimpleSource><SourceFilename relativeToVRT="0">/out/' || s_suppkey || '.tif</SourceFilename><SourceBand>1</SourceBand><SrcRect xOff="0" yOff="0" xSize="10" ySize="' || (5 + s_suppkey % 3) || '"/>'
    || '<DstRect xOff="' || (s_suppkey * 10) || '" yOff="0" xSize="10" ySize="' || (5 + s_suppkey % 3) || '"/></SimpleSource>' t from supplier)
  select '<VRTDataset rasterXSize="100000" rasterYSize="8"><SRS>EPSG:4326</SRS><GeoTransform>0.0,1.0,0.0,8.0,0.0,-1.0</GeoTransform><VRTRasterBand dataType="Int16" band="1"><NoDataValue>-1</NoDataValue>' || string_agg(t, '' order by k)
    || '</VRTRasterBand></VRTDataset>' vrt from b having count(*) > 1""")
def stage_text(spark, sf_dir):
    k = F.col("s_suppkey").cast("long")
    blocks = views.table(spark, sf_dir, "supplier").select(
        k.alias("ordinal"), F.concat(F.lit("/out/"), k.cast("string"), F.lit(".tif")).alias("path"), (k * 10).alias("x"), F.lit(0).cast("long").alias("y"), F.lit(10).cast("long").alias("w"), (5 + k % 3).alias("h")
    )
    return vrt.stage_vrt(blocks, 100000, 8, "Int16", "-1", "EPSG:4326", (0, 1, 0, 8, 0, -1)).select("vrt")


# folders and logs


@query("""with f as (select case when n_nationkey % 3 = 0 then 1 else 0 end folder, 'nation=' || n_nationkey part from nation)
  select row_number() over (order by folder, part || '/') - 1 place, cast(folder as bigint) folder, part from f""")
def folder_files(spark, sf_dir):
    """Files of two folders with all below, found twice where the second also is below the first."""
    n = views.table(spark, sf_dir, "nation")
    path = scratch(spark)
    for name, some in (("a", n.where("n_nationkey % 3 <> 0")), ("b", n.where("n_nationkey % 3 = 0"))):
        some.select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("value")).repartition(1).write.partitionBy("nation").text(f"{path}/{name}")
    found = files.folders(spark, [f"{path}/a", path], (".txt",))
    return longs(found.select(F.col("ord").alias("place"), "folder", F.regexp_extract("path", r"(nation=\d+)", 1).alias("part")), "place", "folder")


@query("select 'nation=' || c_nationkey path from customer group by c_nationkey having bool_or(c_acctbal < -900) or c_nationkey % 9 = 8")
def refreshed_files(spark, sf_dir):
    """Which files of a folder a rewrite changed or left out, by sizes and digests before and after."""
    c, path = views.table(spark, sf_dir, "customer"), scratch(spark)
    before = F.concat_ws(" ", "c_custkey", "c_mktsegment")
    after = F.when(F.col("c_acctbal") < -900, F.upper(F.concat(before, F.lit("x")))).otherwise(before)
    for name, some, line in (("before", c, before), ("after", c.where("c_nationkey % 9 <> 8"), after)):
        rows = some.select(F.col("c_nationkey").alias("nation"), "c_custkey", line.alias("value")).repartition("nation").sortWithinPartitions("nation", "c_custkey")
        rows.select("nation", "value").write.partitionBy("nation").text(f"{path}/{name}")
    seen = [files.digests(spark, f"{path}/{name}").withColumn("path", F.regexp_extract("path", r"(nation=\d+)", 1)) for name in ("before", "after")]
    return planning.unchanged(*seen)


@query("""select strftime(ts, '%Y-%m-%d') "time", case when user_id % 2 = 0 then 'GetObject' else 'HeadObject' end api, 'tiles/' || user_id || '.tif' "object", cast(200 + user_id % 7 as integer) status, 'reader/' || (user_id % 5) user_agent,
  case when user_id % 2 = 0 then 'bytes=' || event_id || '-' || (event_id + 99) end "range", case when user_id % 3 = 0 then 'bytes ' || event_id || '-9/10' end content_range, event_id % 1000 content_length from events""")
def audit_records(spark, sf_dir):
    """A store's audit log, written as JSON lines and read for the six fields that aren't secret."""
    e, u, k = views.table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id").cast("string")
    asked = F.map_filter(F.create_map(F.lit("User-AGENT"), F.concat(F.lit("reader/"), (u % 5).cast("string")), F.lit("Range"), F.when(u % 2 == 0, F.concat(F.lit("bytes="), k, F.lit("-"), (F.col("event_id") + 99).cast("string"))), F.lit("Authorization"), F.lit("secret")), lambda _, v: v.isNotNull())
    sent = F.map_filter(F.create_map(F.lit("Content-Length"), (F.col("event_id") % 1000).cast("string"), F.lit("content-RANGE"), F.when(u % 3 == 0, F.concat(F.lit("bytes "), k, F.lit("-9/10")))), lambda _, v: v.isNotNull())
    api = F.struct(F.when(u % 2 == 0, "GetObject").otherwise("HeadObject").alias("name"), F.concat(F.lit("tiles/"), u.cast("string"), F.lit(".tif")).alias("object"), (200 + u % 7).cast("int").alias("statusCode"))
    path = scratch(spark)
    e.select(F.date_format("ts", "yyyy-MM-dd").alias("time"), api.alias("api"), asked.alias("requestHeader"), sent.alias("responseHeader")).write.json(path)
    return telemetry.audit_events(spark, path)


# vector tiles, features and styles


@query("select c_nationkey tile, c_mktsegment layer, cast(count(*) as integer) features from customer group by all")
def tile_features(spark, sf_dir):
    """Vector tiles of the customers of each nation, a layer for each segment, encoded as columns and decoded in tasks."""
    c = views.table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    layer = F.concat(vector.field(1, F.hex(F.encode("c_mktsegment", "utf-8"))), F.expr("repeat('1200', cast(n as int))"), F.lit("7802"))
    tile = c.groupBy(F.col("c_nationkey").alias("tile")).agg(F.unhex(F.array_join(F.collect_list(vector.field(3, layer)), "")).alias("tile_data"))
    return vector.features(tile, ["tile"])


@query("""with f as (select c_mktsegment layer, 'n' || c_nationkey k, bool_or(c_acctbal < -500) own from customer where c_acctbal > 9000 or c_acctbal < -500 group by all),
  l as (select layer, string_agg('"' || k || '":"' || case when own then 'Number' else 'String' end || '"', ',' order by k) f from f group by layer)
  select 'format' as name, 'pbf' as "value" union all select 'json', '{"vector_layers":[' || string_agg('{"id":"' || layer || '","fields":{' || f || '}}', ',' order by layer) || ']}' from l""")
def completed_metadata(spark, sf_dir):
    """A tile set's metadata, a layer for each market segment, with the fields that styles need besides its own."""
    c = views.table(spark, sf_dir, "customer")

    def fields(some: DataFrame, kind: str) -> DataFrame:
        return some.groupBy(F.col("c_mktsegment").alias("layer")).agg(F.map_from_entries(F.collect_set(F.struct(F.concat(F.lit("n"), "c_nationkey").alias("k"), F.lit(kind).alias("v")))).alias("fields"))

    own = fields(c.where("c_acctbal < -500"), "Number").select(F.struct(F.col("layer").alias("id"), "fields").alias("l"))
    text = own.agg(F.to_json(F.struct(F.collect_list("l").alias("vector_layers"))).alias("value")).select(F.lit("json").alias("name"), "value")
    metadata = text.union(spark.createDataFrame([("format", "pbf")], "name string, value string"))
    return vector.normalized_metadata(metadata, fields(c.where("c_acctbal > 9000"), "String"))


@query("select 'c' || c_custkey as name, 'Point' kind, '[' || (c_custkey * 37 % 360 - 180) || ',' || (c_custkey * 53 % 160 - 80) || ']' coordinates, c_custkey % 6 i from customer")
def geojson_places(spark, sf_dir):
    """Documents of up to six features each, read again as features in order."""
    k = F.col("c_custkey")
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.concat(F.lit("c"), k.cast("string")).alias("name")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(k * 37 % 360 - 180, k * 53 % 160 - 80).alias("coordinates")).alias("geometry")
    )
    docs = views.table(spark, sf_dir, "customer").groupBy(F.floor(k / 6).alias("d")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), feature.alias("f")))).alias("all"))
    texts = docs.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("all", lambda x: x["f"]).alias("features"))).alias("value"))
    return longs(vector.geojson_features(texts).select("name", "kind", "coordinates", "i"), "i")


def _styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A style document per part: a background, water, and a layer that filters by the brand and writes a name."""
    p, k = views.table(spark, sf_dir, "part"), F.col("p_partkey")
    text = F.concat(
        F.lit('{"layers": [{"id": "bg", "type": "background", "paint": {"background-color": "#'), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit('"}}, {"id": "w", "type": "fill", "source-layer": "water", "paint": {"fill-color": "blue"}}, {"id": "a", "type": "symbol", "source-layer": "'),
        F.lower("p_type"), F.lit('", "minzoom": '), (k % 12).cast("string"), F.lit(', "maxzoom": '), (4 + k % 15).cast("string"), F.lit(', "filter": [">", "'), "p_brand", F.lit('", '), F.col("p_size").cast("string"), F.lit('], "layout": {"text-field": "{name_'), (k % 3).cast("string"), F.lit('}"}}]}'),
    )
    return p.select(k.alias("id"), text.alias("style"))


@query("""with f as (select p_partkey id, lower(p_type) layer, p_brand field, 'Number' kind from part union all select p_partkey, lower(p_type), 'name_' || (p_partkey % 3), 'String' from part) select * from f""")
def style_fields(spark, sf_dir):
    made = _styles(spark, sf_dir).select("id", F.explode(vector.required_fields("style")).alias("s"))
    return made.select("id", F.col("s.layer").alias("layer"), F.explode("s.fields").alias("field", "kind"))


@query("""with s as (select p_partkey id, greatest(6, p_partkey % 12) low, 4 + p_partkey % 15 high, '#' || lpad((p_partkey % 1000)::varchar, 3, '0') land from part)
  select id, cast(11 + (high > low)::integer as integer) layers, case when high > low then low end low, land, 'blue' water from s""")
def adapted_styles(spark, sf_dir):
    """The style over world layers: how many layers it has, where its own begins, and the colours that the world takes from it."""
    made = _styles(spark, sf_dir).select("id", vector.with_world_below("style").alias("s"))
    shape = "layers array<struct<id:string,minzoom:bigint,paint:map<string,string>>>"
    made = made.select("id", F.from_json("s", shape)["layers"].alias("l"))
    at = lambda name: F.get(F.filter("l", lambda x: x["id"] == name), F.lit(0))
    return made.select("id", F.size("l").alias("layers"), at("a")["minzoom"].alias("low"), at("world-land-50")["paint"]["fill-color"].alias("land"), at("world-ocean-10")["paint"]["fill-color"].alias("water"))


@query("select p_partkey id, round(p_retailprice * 1.00000001::double, 6) low, round(p_size * 1000 * 1.00000001::double, 6) high from part")
def widened_scales(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    text = F.concat(F.lit("<Rule><MinScaleDenominator>"), F.col("p_retailprice").cast("double").cast("string"), F.lit("</MinScaleDenominator><sld:MaxScaleDenominator>"), (F.col("p_size") * 1000).cast("string"), F.lit("</sld:MaxScaleDenominator></Rule>"))
    made = p.select(F.col("p_partkey").alias("id"), vector.widened_scales(text).alias("s"))
    number = lambda tag: F.round(F.regexp_extract("s", rf"<(?:sld:)?{tag}>([^<]+)<", 1).cast("double"), 6)
    return made.select("id", number("MinScaleDenominator").alias("low"), number("MaxScaleDenominator").alias("high"))


@query("""with s as (select *, p_partkey % 3 > 0 label, p_partkey % 2 = 0 poi from part)
  select p_partkey id, cast(1 + label::integer as integer) rules, case when label then p_brand || '-unlabelled-icon' else '' end name, cast(case when label then p_size * 1000 else 0 end as integer) least_scale,
  cast(case when label and p_partkey % 5 < 2 then 2 else 0 end as integer) conditions, cast(case when label then case when p_partkey % 7 > 0 then p_partkey else 1000 end else 0 end as integer) priority,
  cast(case when label and poi then greatest(16, p_size) else p_size end as integer) space, cast(case when label then 40 else 0 end as integer) icon_space, case when label then ' ' else '' end icon_label from s""")
def icon_rules(spark, sf_dir):
    """What each part's style of one rule becomes: how many rules, what the added one is called, asks for and draws, and the space around the labelled icon."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    tag = lambda name, *inside, more="": F.concat(F.lit(f"<{name}{more}>"), *[F.lit(x) if isinstance(x, str) else x for x in inside], F.lit(f"</{name}>"))
    filter_ = F.when(k % 5 < 2, tag("ogc:Filter", tag("ogc:PropertyIsEqualTo", tag("ogc:PropertyName", "class"), tag("ogc:Literal", F.col("p_brand"))))).otherwise("")
    label = tag("Label", tag("ogc:PropertyName", F.when(k % 3 > 0, "name:en").otherwise("ref")))
    symbol = tag("TextSymbolizer", label, tag("Graphic", tag("Size", size)), F.when(k % 7 > 0, tag("Priority", k.cast("string"))).otherwise(""), tag("VendorOption", size, more=' name="spaceAround"'))
    rule = tag("Rule", tag("Name", F.col("p_brand")), filter_, tag("MinScaleDenominator", (F.col("p_size") * 1000).cast("string")), symbol)
    layer = tag("NamedLayer", tag("Name", F.when(k % 2 == 0, "w:poi").otherwise("w:road")), tag("UserStyle", tag("FeatureTypeStyle", rule)))
    text = tag("StyledLayerDescriptor", layer, more=' xmlns="http://www.opengis.net/sld" xmlns:ogc="http://www.opengis.net/ogc"')
    made = spread(views.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")).select(k.alias("id"), vector.with_unlabelled_icons(text).alias("s"))
    step = lambda *names: "".join(f"/*[name()='{n}']" for n in names)
    added, icon = "/" + step("sld:Rule"), "/" + step("sld:Rule", "sld:TextSymbolizer")
    number = lambda path: F.xpath_int("s", F.lit(path))
    said = lambda path: F.xpath_string("s", F.lit(path))
    return made.select(
        "id", number("count(//*[name()='Rule'] | //*[name()='sld:Rule'])").alias("rules"), said(added + step("sld:Name")).alias("name"), number(added + step("MinScaleDenominator")).alias("least_scale"),
        number(f"count({added}{step('ogc:Filter', 'ogc:And')}/*)").alias("conditions"), number(icon + step("sld:Priority", "ogc:Sub") + "/*[1]").alias("priority"),
        number("/" + step("Rule", "TextSymbolizer") + "/*[@name='spaceAround']").alias("space"), number(icon + "/*[@name='spaceAround']").alias("icon_space"), said(icon + step("sld:Label")).alias("icon_label"),
    )


# shapes


@query("""with s as (select s_suppkey k, cast(s_suppkey * 37 % 90 as double) x, cast(s_suppkey * 53 % 70 as double) y, cast(1 + s_suppkey % 9 as double) w from supplier)
  select 's' || k as name, round(x + w, 6) xmax, 5 points, round(w * (w + 0.5), 6)::double area from s where x + w <= 60 and y >= 10""")
def clipped_shapes(spark, sf_dir):
    """Suppliers as polygons, through shapefiles: those of a window, which their boxes alone tell, with the area of their outer ring."""
    shapefile.register(spark)
    s = F.col("s_suppkey")
    x, y, w = s * 37 % 90 * 1.0, s * 53 % 70 * 1.0, 1.0 + s % 9
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(point(x, y), point(x, y + w + 0.5), point(x + w, y + w + 0.5), point(x + w, y), point(x, y))
    path = scratch(spark)
    rows = views.table(spark, sf_dir, "supplier").select(F.array(ring).alias("parts"), F.create_map(F.lit("name"), F.concat(F.lit("s"), s.cast("string"))).alias("fields"))
    rows.write.format("shapefile").mode("append").options(path=path, kind="polygon", fields="name").save()
    read = spark.read.format("shapefile").load(path).where("xmax <= 60 and ymin >= 10")
    made = read.select(F.col("fields")["name"].alias("name"), "xmax", F.get("parts", F.lit(0)).alias("ring"))
    return rounded(made.select("name", "xmax", F.size("ring").alias("points"), projection.ring_area(F.col("ring")).alias("area")), "xmax", "area")


@query("""with c as (select l_linenumber band, l_partkey % 64 x, l_orderkey % 64 y, cast(max(l_quantity) as bigint) v from lineitem where l_linenumber < 4 group by all)
  select x, y, max(v) filter (band = 1) r, max(v) filter (band = 2) g, max(v) filter (band = 3) b from c where x between 20 and 43 and y between 10 and 30 group by x, y""")
def rgb_window(spark, sf_dir):
    """A window of three bands of bytes, of which only the tiles that it meets are read."""
    geotiff.register(spark)
    t = views.table(spark, sf_dir, "lineitem").where("l_linenumber < 4")
    cells = t.groupBy(F.col("l_linenumber").alias("band"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_orderkey") % 64).alias("y")).agg(F.max("l_quantity").cast("double").alias("v"))
    cells = cells.select(F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("ord"), "band", "x", "y", "v", F.lit(True).alias("valid"))
    path = scratch(spark)
    rows = tiles.pack(cells, 16).select(F.lit("rgb").alias("block"), "band", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), tiles.filled("samples", "valid", 0.0).alias("samples"))
    rows.repartition("block").sortWithinPartitions("block").write.format("geotiff").mode("append").options(path=path, edge=16, width=64, height=64, bands=3, dtype="uint8", nodata="0", crs="EPSG:3857", grid="0,1,0,0,0,-1", compression="lzw").save()
    read = tiles.window_cells(spark.read.format("geotiff").option("window", "20,10,24,21").load(path)).where("x between 20 and 43 and y between 10 and 30 and v > 0")
    return longs(read.groupBy("x", "y").agg(*[F.max(F.when(F.col("band") == k, F.col("v"))).alias(c) for k, c in enumerate("rgb", 1)]), *"xyrgb")


@query(f"with {_LAYERS} select s, x, y, v from layers where x between 10 and 40 and y between 5 and 17")
def indexed_window(spark, sf_dir):
    """A window in coordinates of the five rasters, through an index of their footprints; all five lie in one place, so all are met."""
    path = _written(spark, sf_dir, compression="zstd")
    read = jobs.window(spark, path, written(jobs.footprints(spark, path)), (1100.0, 1820.0, 1410.0, 1950.0))
    cells = tiles.window_cells(read).where("x between 10 and 40 and y between 5 and 17")
    return longs(cells.select(F.regexp_extract("path", r"s(\d+)\.tif$", 1).alias("s"), "x", "y", "v"), "s", "v")


_POST = "(k * 7 + x * 13 + y * 5) % 500 - 100"


@query(f"""with c as (select s_suppkey k, 2 + s_suppkey % 3 n from supplier), g as (select k, n, x.x x, y.y y from c, range(0, 7) x(x), range(0, 13) y(y) where x.x <= n and y.y <= n * 2)
  select k, x, y, {_POST} v, 2 factor, cast(k % 180 - 90 as integer) west from g where (k + x + y) % 11 > 0""")
def elevation_posts(spark, sf_dir):
    """Suppliers as cells of elevation, two posts to the north for each to the east, written as DTED of level 1 beside others of level 0, and read again."""
    dted.register(spark)
    k, n = F.col("k"), F.col("n")
    cells = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), (2 + F.col("s_suppkey") % 3).cast("int").alias("n"))
    columns = cells.select("k", "n", F.explode(F.sequence(F.lit(0), n)).alias("x"))
    posts = F.transform(F.sequence(F.lit(0), n * 2), lambda y: F.when((k + F.col("x") + y) % 11 > 0, (k * 7 + F.col("x") * 13 + y * 5) % 500 - 100).otherwise(dted.NODATA).cast("int"))
    rows = columns.select(F.concat(F.lit("w/c"), k.cast("string"), F.lit(".dt1")).alias("path"), (k % 180 - 90).cast("int").alias("west"), F.lit(10).alias("south"), "x", posts.alias("posts"))
    path = scratch(spark)
    rows = rows.unionByName(rows.withColumn("path", F.replace("path", F.lit(".dt1"), F.lit(".dt0"))))
    rows.repartition("path").sortWithinPartitions("path", "x").write.format("dted").mode("append").save(path)
    read = spark.read.format("dted").option("level", "1")
    heads = read.load(path).where("valid").join(spark.read.format("dted").options(level="1", mode="metadata").load(path).select("path", "west"), "path")
    return longs(heads.select(F.regexp_extract("path", r"c(\d+)\.dt1$", 1).alias("k"), "x", "y", "v", "factor", "west"), "k", "v")


@query("""with t as (select n_regionkey r, c_custkey % 5 + 3 z, c_custkey // 5 % 40 x, c_custkey % 7 y, max(c_custkey) k from customer join nation on c_nationkey = n_nationkey group by all)
  select cast(r as bigint) region, z zoom_level, count(*) tiles, cast(sum(3 + k % 50) as bigint) bytes from t group by all""")
def tile_sets(spark, sf_dir):
    """Customers of a region as a tile set, a file each, read again for tiles and bytes of each zoom level."""
    k = F.col("c_custkey")
    c = views.table(spark, sf_dir, "customer").join(views.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("tile_set"), (k % 5 + 3).cast("int").alias("zoom_level"), (F.floor(k / 5) % 40).alias("tile_column"), (k % 7).cast("long").alias("tile_row"), k.alias("k"),
        F.encode(F.expr("repeat('t', cast(3 + c_custkey % 50 as int))"), "utf-8").alias("tile_data"),
    )
    sqlite.register(spark)
    path = scratch(spark)
    rows.repartition("tile_set").sortWithinPartitions("tile_set", "k").drop("k").write.format("tileset").mode("append").options(path=path, metadata='{"format": "pbf"}').save()
    store, folder = files.opened(path)
    made = None
    for info in store.get_file_info(fs.FileSelector(folder)):  # a file for each of the few regions
        one = sqlite.zoom_payload(sqlite.read(spark, info.path, "tiles")).select(F.lit(int(info.base_name[1:-8])).cast("long").alias("region"), "zoom_level", "tiles", "bytes")
        made = one if made is None else made.unionByName(one)
    return longs(made, "zoom_level")
