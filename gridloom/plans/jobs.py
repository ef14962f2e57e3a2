"""Whole jobs: merging GeoTIFFs into verified blocks, pyramids of files, and jobs that can be watched and stopped."""

from __future__ import annotations

import functools
import hashlib
import json
import operator
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import codecs
from gridloom.functions.ranks import running
from gridloom.functions.rects import overview_sizes, whole
from gridloom.functions.shared import intermediates, written
from gridloom.operators import planning, resample, tiles
from gridloom.operators import windows as rasters
from gridloom.sources import files, geotiff
from gridloom.sources import overviews as sidecars


class InputError(ValueError):
    """Sources that can't be merged, with the first reason."""


def inventory(spark: SparkSession, path: str, tolerance: float = 1e-7) -> DataFrame:
    """The files at `path` as ord, path, their metadata and x, y, their place on the grid of the first by name.

    Only headers are read. Files of another type, NoData value, pixel size, coordinate system, alignment or meaning of a pixel (point or
    area) than the first raise, and so do alpha bands, palettes, 64-bit integers, and NoData values that the type can't hold.
    """
    geotiff.register(spark)
    meta = spark.read.format("geotiff").option("mode", "metadata").load(path)
    meta = running(meta, [F.lower("path"), "path"], place="ord").withColumn("ord", F.col("ord").cast("long"))
    first = F.broadcast(meta.where("ord = 0").select(*[F.col(c).alias(f"first_{c}") for c in ("path", "bands", "dtype", "nodata", "a", "b", "d", "e", "system", "point", "c", "f")]))
    placed = meta.join(first, F.lit(True))
    x, y = (F.col("c") - F.col("first_c")) / F.col("a"), (F.col("f") - F.col("first_f")) / F.col("e")
    same = lambda *names: functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in names])
    placed = placed.withColumns({"px": x, "py": y})
    faults = [
        (F.col("alpha"), "has an alpha band"), (F.col("palette"), "has a palette"), (F.col("dtype").isin("int64", "uint64"), "has 64-bit integers"),
        (~same("bands", "dtype", "nodata", "a", "b", "d", "e"), "has another type, NoData value or pixel size than the first file"), (~same("system"), "has another coordinate system than the first file"),
        (~same("point"), "is of points or areas where the first file is not: points and areas can't be mixed"),
        (~(whole(F.col("px"), tolerance) & whole(F.col("py"), tolerance)) | (F.col("b") != 0) | (F.col("d") != 0), "is rotated or not aligned with the first file"),
    ]
    fault = functools.reduce(lambda rest, k: F.when(faults[k][0], k).otherwise(rest), reversed(range(len(faults))), F.lit(None).cast("int"))
    odd = placed.select("path", "ord", "dtype", "nodata", fault.alias("fault")).where("fault is not null or ord = 0").orderBy(F.asc_nulls_last("fault"), "path").head(1)
    if odd and odd[0].fault is not None:
        raise InputError(f"{odd[0].path} {faults[odd[0].fault][1]}")
    if odd and odd[0].nodata is not None and not geotiff.representable(odd[0].nodata, odd[0].dtype):
        raise InputError(f"{odd[0].path}: {odd[0].dtype} can't hold its NoData value {odd[0].nodata}")
    return placed.withColumns({"x": F.rint("px").cast("long"), "y": F.rint("py").cast("long")}).select(*meta.columns, "x", "y")


def results(spark: SparkSession, path: str) -> DataFrame:
    """The inventory of rasters that an earlier job left at `path`, with west, south and per_degree: heights on one grid of whole samples a degree.

    Every file must have one band of int16 or float32, a NoData value that the type holds and no mask, EPSG:4326, a grid that is aligned with the first one's, and
    the same metadata but for statistics (scales, offsets, units and descriptions are metadata too); else InputError names the first that hasn't.
    """
    found = inventory(spark, path)
    kept = F.map_filter("items", lambda k, _: ~F.startswith(k, F.lit("STATISTICS_")))
    found = found.withColumns({"kept": F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))), "per_degree": 1 / F.col("a")})
    first = F.broadcast(found.where("ord = 0").select(F.col("kept").alias("first_kept")))
    west, north = F.col("c") + F.col("a") / 2, F.col("f") + F.col("e") / 2
    faults = [
        ((F.col("bands") != 1) | ~F.col("dtype").isin("int16", "float32"), "needs one band of int16 or float32"), (F.col("nodata").isNull() | F.isnan("nodata") | F.col("masked"), "needs a NoData value and no mask"),
        (F.coalesce(F.col("crs") != "EPSG:4326", F.lit(True)), "is not in EPSG:4326"), ((F.col("a") <= 0) | (F.col("e") >= 0), "is not north-up"),
        (~whole(F.col("per_degree"), 1e-6) | ~whole(west * F.col("per_degree"), 1e-6) | ~whole(north * F.col("per_degree"), 1e-6), "has no whole samples a degree"),
        (~F.col("kept").eqNullSafe(F.col("first_kept")), "has other metadata than the first file"),
    ]
    fault = functools.reduce(lambda rest, k: F.when(faults[k][0], k).otherwise(rest), reversed(range(len(faults))), F.lit(None).cast("int"))
    placed = found.join(first, F.lit(True)).withColumns({"fault": fault, "west": west, "south": north + (F.col("height") - 1) * F.col("e")})
    odd = placed.where("fault is not null").orderBy("fault", "path").head(1)
    if odd:
        raise InputError(f"{odd[0].path} {faults[odd[0].fault][1]}")
    return placed.drop("kept", "first_kept", "fault")


def footprints(spark: SparkSession, path: str) -> DataFrame:
    """The index of a mosaic: path, west, south, east, north of each file from its header alone. Written once, it spares later reads the files they don't meet."""
    geotiff.register(spark)
    meta = spark.read.format("geotiff").option("mode", "metadata").load(path)
    xs, ys = (F.col("c"), F.col("c") + F.col("a") * F.col("width")), (F.col("f"), F.col("f") + F.col("e") * F.col("height"))
    return meta.select("path", F.least(*xs).alias("west"), F.least(*ys).alias("south"), F.greatest(*xs).alias("east"), F.greatest(*ys).alias("north"))


def window(spark: SparkSession, path: str, index: DataFrame, box: tuple[float, float, float, float], stored: bool = False) -> DataFrame:
    """The stored tiles of a mosaic's files that meet a box of coordinates. Files that the index rules out aren't opened; of the others the header and
    the tiles inside are asked for, neighbouring tiles in one range of bytes, and never a whole file."""
    west, south, east, north = map(float, box)
    met = index.where((F.col("west") < east) & (F.col("east") > west) & (F.col("south") < north) & (F.col("north") > south)).select("path").limit(BROADCAST_SOURCES + 1).collect()
    options = {"box": f"{west!r},{south!r},{east!r},{north!r}", "samples": "stored" if stored else "double"}
    if len(met) <= BROADCAST_SOURCES:
        options["files"] = json.dumps([r.path for r in met])
    geotiff.register(spark)
    return spark.read.format("geotiff").options(**options).load(path)


#: Sources up to which their places are sent to all tasks; beyond, windows are shuffled by path.
BROADCAST_SOURCES = 200_000


def _block(bx, by):
    return F.format_string("block_%04d_%04d", by, bx)


def _resumed(spark: SparkSession, output: str, blocks: DataFrame, signature: str) -> DataFrame:
    """The blocks that are still to be written: those whose file isn't there as the state has it. Other inputs, options or files raise."""
    store, folder = files.opened(output)
    plan = f"{folder}/_state/plan.json"
    there = spark.createDataFrame([(x.base_name.rsplit(".", 1)[0], x.path) for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.is_file and x.path.lower().endswith((".tif", ".tiff"))], "block string, path string")
    if not store.get_file_info(plan).is_file:
        if there.head(1):
            raise InputError(f"{output} has rasters but no state of a job")
        store.create_dir(f"{folder}/_state/blocks", recursive=True)
        with store.open_output_stream(plan) as out:
            out.write(json.dumps({"signature": signature}).encode())
        return blocks
    with store.open_input_file(plan) as stream:
        if json.loads(stream.read())["signature"] != signature:
            raise InputError(f"{output} belongs to other inputs or options")
    state = spark.read.schema("block string, bytes long, sha256 string").json(f"{output}/_state/blocks")
    status = planning.resumption(blocks, state, files.fingerprints(there))
    status = written(status)
    odd = status.where("status = 'unexpected'").orderBy("block").head(1)
    if odd:
        raise InputError(f"{output} has {odd[0].block}, which is no block of this job")
    return status.where("status <> 'done'").select("block")


def merge(spark: SparkSession, path: str, output: str, policy: str = "last", edge: int = 512, block_tiles: int = 16, nodata: float | None = None, compression: str = "deflate", predictor: int = 1, overviews: str = "none", level: int | None = None, resume: bool = False) -> DataFrame:
    """Merges the GeoTIFFs at `path` into blocks under `output`, reads those again and gives the verification by band.

    policy: first, last, or error, which raises where valid samples differ. nodata: for sources that have none; where neither has one, a mask
    directory says what no source covers or masks. Samples keep the files' type: windows are cut at the tiles of the common grid, meet
    in one shuffle by block, and each block is composed and written by one task. The check reads sources and blocks, composes the sources from
    the other end of their order with gaps filled where the writer overwrites, and compares bits in one more shuffle. Where it finds any difference
    the files that this call wrote are deleted and InputError is raised.

    resume: each block appears as soon as it is whole, with a row of state; a call over the same inputs and options checks the
    digests of what is there and writes only the rest. Otherwise all files appear or none.
    """
    if (said := spark.range(1).select(codecs.fault(F.lit(compression), F.lit(level).cast("int"), F.lit(predictor), F.lit(True)).alias("f")).first().f) is not None:
        raise InputError(said)
    with intermediates(spark):
        return _merge(spark, path, output, policy, edge, block_tiles, nodata, compression, predictor, overviews, level, resume)


def _merge(spark, path, output, policy, edge, block_tiles, nodata, compression, predictor, overviews, level, resume):
    sources = inventory(spark, path)
    box = sources.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("r"), F.max(F.col("y") + F.col("height")).alias("b"), F.count("*").alias("n")).first()
    one = sources.where("ord = 0").first()
    if one is None:
        raise InputError(f"no GeoTIFF at {path}")
    missing = one.nodata if one.nodata is not None else nodata
    if predictor == 3 and not one.dtype.startswith("float"):
        raise InputError("predictor 3 is for floating-point samples")
    if missing is not None and not geotiff.representable(float(missing), one.dtype):
        raise InputError(f"{one.dtype} can't hold NoData {missing}")
    width, height, step = box.r - box.x, box.b - box.y, block_tiles * edge
    place = sources.select("path", "ord", (F.col("x") - box.x).alias("ox"), (F.col("y") - box.y).alias("oy"))
    corner = (one.c + box.x * one.a, one.f + box.y * one.e)
    options = {"path": output, "edge": edge, "width": step, "height": step, "total_width": width, "total_height": height, "bands": one.bands, "dtype": one.dtype, "samples": "stored",
               "compression": compression, "predictor": predictor, "grid": ",".join(map(repr, (corner[0], one.a, 0.0, corner[1], 0.0, one.e))), "overviews": overviews}
    options |= {"geo": one.geo} if one.geo is not None else {}
    options |= {"level": level} if level is not None else {}
    options |= {"nodata": repr(float(missing))} if missing is not None else {"mask": "yes"}

    def windows(**more) -> DataFrame:
        read = spark.read.format("geotiff").options(samples="stored", strict="true", **more).load(path)
        side = F.broadcast(place) if box.n <= BROADCAST_SOURCES else place
        return read.join(side, "path").withColumns({"x": F.col("x") + F.col("ox"), "y": F.col("y") + F.col("oy")})

    if policy == "error":
        clash = _strict(lambda: rasters.conflicts(rasters.parts(windows(), edge, one.dtype), edge, one.dtype).orderBy("first", "second").head(1))
        if clash:
            raise InputError(f"sources {clash[0].first} and {clash[0].second} differ in {clash[0].n} samples, first at {clash[0].x}, {clash[0].y}")
    span = lambda at, n: F.sequence(F.floor(F.col(at) / step), F.floor((F.col(at) + F.col(n) - 1) / step))
    own = sources.select("path", (F.col("x") - box.x).alias("x"), (F.col("y") - box.y).alias("y"), "width", "height")
    own = own.select("path", "y", "height", F.explode(span("x", "width")).alias("bx")).select("path", "bx", F.explode(span("y", "height")).alias("by")).select("path", _block(F.col("bx"), F.col("by")).alias("block"))
    todo = blocks = own.select("block").distinct()
    bx, by = F.floor(F.col("tx") / block_tiles), F.floor(F.col("ty") / block_tiles)
    more = {}
    if resume:
        facts = sources.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("path", "stored_bytes", "width", "height", "c", "f")).alias("x"), F.sum(F.xxhash64("path", "stored_bytes", "ord").cast("decimal(38,0)")).alias("s")).first()
        signature = hashlib.sha256(json.dumps([*map(str, facts), policy, block_tiles, options], sort_keys=True).encode()).hexdigest()
        todo = written(_resumed(spark, output, blocks, signature))
        options["state"] = f"{output}/_state/blocks"
        wanted = own.join(todo, "block", "left_semi").select("path").distinct().limit(BROADCAST_SOURCES + 1).collect()
        if len(wanted) <= BROADCAST_SOURCES:
            more["files"] = json.dumps([r.path for r in wanted])
    cut = rasters.parts(windows(**more), edge, one.dtype).withColumn("block", _block(bx, by))
    if resume:
        cut = cut.join(todo, "block", "left_semi")
    keys = ["block", *rasters.PLACE]
    made = rasters.composed(cut.repartition("block").sortWithinPartitions(*keys, "ord"), edge, one.dtype, "first" if policy == "first" else "last", 0.0 if missing is None else float(missing))
    rows = made.select(
        _block(bx, by).alias("block"), "band", (F.col("tx") - bx * block_tiles).cast("int").alias("tx"), (F.col("ty") - by * block_tiles).cast("int").alias("ty"), "samples", "valid", (bx * step).alias("left"), (by * step).alias("top")
    )
    if not resume or more.get("files") != "[]":
        _strict(lambda: rows.write.format("geotiff").mode("append").options(**options).save())
    meta = spark.read.format("geotiff").option("mode", "metadata").load(output)
    there = meta.select("path", F.rint((F.col("c") - corner[0]) / F.col("a")).cast("long").alias("ox"), F.rint((F.col("f") - corner[1]) / F.col("e")).cast("long").alias("oy"))
    back = spark.read.format("geotiff").option("samples", "stored").load(output).join(there, "path").withColumns({"x": F.col("x") + F.col("ox"), "y": F.col("y") + F.col("oy"), "ord": F.lit(0).cast("long")})
    other = rasters.parts(windows().withColumn("ord", -F.col("ord")), edge, one.dtype)
    report = rasters.verify(other, rasters.parts(back, edge, one.dtype), edge, one.dtype, "last" if policy == "first" else "first")
    found = report.orderBy("band").collect()
    wrong = [r for r in found if r.missing or r.unexpected or r.different]
    if wrong:
        store, folder = files.opened(output)
        for r in todo.collect():
            for name in (f"{folder}/{r.block}.tif", f"{folder}/_state/blocks/{r.block}.json"):
                if store.get_file_info(name).is_file:
                    store.delete_file(name)
        raise InputError(f"band {wrong[0].band} came back with {wrong[0].missing} samples missing, {wrong[0].unexpected} unexpected and {wrong[0].different} different")
    return spark.createDataFrame(found, report.schema)


def _strict(work):
    """The result of `work`; a source whose mask contradicts its NoData value, or bands of different masks without one, make an InputError."""
    try:
        return work()
    except Exception as error:
        for said in ("its mask has NoData values marked valid", "bands of different masks need a NoData value"):
            if said in str(error):
                raise InputError(next((x.split("ValueError: ")[-1] for x in str(error).splitlines() if said in x), said)) from error
        raise


def without_overviews(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files that have no overviews inside yet, largest first: those that a run still has to do."""
    geotiff.register(spark)
    meta = spark.read.format("geotiff").option("mode", "metadata").load(path)
    return meta.where("levels = 0").select("path", "width", "height", "stored_bytes").orderBy(F.desc("stored_bytes"), "path")


def structure(spark: SparkSession, path: str) -> DataFrame:
    """(path, faults, valid): what keeps files from being cloud optimised, from their directories alone."""
    geotiff.register(spark)
    meta = spark.read.format("geotiff").option("mode", "metadata").load(path)
    return meta.select("path", "faults", (F.size("faults") == 0).alias("valid"))


def plan(spark: SparkSession, path: str, target_pixels: int) -> DataFrame:
    """A dry run: the output rectangles that a merge would write, from headers alone."""
    return planning.regions(inventory(spark, path).select("x", "y", F.col("width").alias("w"), F.col("height").alias("h")), target_pixels)


def overviews(spark: SparkSession, path: str, least: int = 512) -> DataFrame:
    """(path, level, band, x, y, v): the pyramid of each file down to `least` pixels, each level from the one before."""
    geotiff.register(spark)
    sizes = spark.read.format("geotiff").option("mode", "metadata").load(path).agg(F.max(F.greatest("width", "height"))).first()[0] or 0
    level, out, size = tiles.window_cells(spark.read.format("geotiff").load(path)), None, sizes
    n = 0
    while size > least:
        n, size = n + 1, -(-size // 2)
        level = resample.halve(level, ["path", "band"])
        named = level.withColumn("level", F.lit(n)).select("path", "level", "band", "x", "y", "v")
        out = named if out is None else out.union(named)
    return out if out is not None else spark.createDataFrame([], "path string, level int, band int, x long, y long, v double")


def _encoded_tiles(edge: int, dtype: str, codec: str, predictor: int, nodata: float | None, masked: bool):
    """Windows of a level (STORED, level, path) to rows of `overviews`: a stored tile, the mask's tile with the first band, and their sizes."""
    kind = np.dtype(dtype).newbyteorder("<")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                h, w, ty, tx = r["h"], r["w"], r["y"] // edge, r["x"] // edge
                x, good = np.frombuffer(r["samples"], kind).reshape(h, w), np.ones((h, w), bool)
                if r["valid"] is not None:
                    good = np.unpackbits(np.frombuffer(r["valid"], np.uint8))[: h * w].reshape(h, w) > 0
                tile = np.full((edge, edge), 0 if nodata is None else nodata, kind)
                tile[:h, :w] = np.where(good, x, tile[:h, :w])
                data = geotiff.encoded(geotiff.differenced(tile, predictor), codec, None)
                out.append((r["path"], r["level"], r["band"], ty, tx, data))
                if masked and r["band"] == 1:
                    whole_ = np.zeros((edge, edge), np.uint8)
                    whole_[:h, :w] = good
                    out.append((r["path"], r["level"], 0, ty, tx, geotiff.encoded(np.packbits(whole_, axis=1).tobytes(), "deflate", None)))
            rows = [(p, role, k, b, ty, tx, len(d), d if role == 2 else None) for p, k, b, ty, tx, d in out for role in (1, 2)]
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((),) * 8, types, strict=True)], [c.split()[0] for c in sidecars.ROWS.split(", ")])

    return run


def external_overviews(spark: SparkSession, path: str, method: str = "average", least: int = 256, edge: int = 256, compression: str = "deflate") -> DataFrame:
    """Writes a file .ovr beside each GeoTIFF at `path`, of levels that halve until neither side is over `least`. Gives (path, status, levels).

    A raster at or below `least` is skipped (`small`), so is one with overviews inside (`internal`); the others' stale sidecars go when the new ones are whole (`ok`).
    A palette takes nearest only. Levels are made of tiles that meet by shuffle, level from level, so no task holds more than four tiles of one;
    the file is written as a stream of tiles that other tasks have encoded. Integers and masks, NoData and predictors stay as the raster has
    them. The new files are read again, and sizes that aren't as asked raise.
    """
    with intermediates(spark):
        return _external_overviews(spark, path, method, least, edge, compression)


def _external_overviews(spark, path, method, least, edge, compression):
    geotiff.register(spark)
    sidecars.register(spark)
    meta = written(spark.read.format("geotiff").option("mode", "metadata").load(path).withColumn("ord", F.xxhash64("path")))
    if method != "nearest" and (held := meta.where("palette").head(1)):
        raise InputError(f"{held[0].path} has a palette, which can't be averaged")
    size = F.greatest("width", "height")
    depth = F.size(overview_sizes(F.col("width"), F.col("height"), least))
    status = F.when(size <= least, "small").when(F.col("levels") > 0, "internal").otherwise("ok")
    todo = written(meta.select("*", status.alias("status"), F.when(status == "ok", depth).otherwise(0).alias("made")))
    kinds = todo.where("status = 'ok'").select("dtype", "nodata", "masked").distinct().collect()  # of types there are a dozen
    for kind in kinds:
        mine = todo.where((F.col("status") == "ok") & (F.col("dtype") == kind.dtype) & F.col("nodata").eqNullSafe(kind.nodata) & (F.col("masked") == kind.masked))
        predictor = 3 if kind.dtype.startswith("float") else 2
        masked = kind.masked and kind.nodata is None
        side = mine.select("path", "ord", "made")
        side = F.broadcast(side) if side.count() <= BROADCAST_SOURCES else side
        level = spark.read.format("geotiff").option("samples", "stored").load(path).join(side, "path").select("ord", "band", "x", "y", "w", "h", "samples", "valid")
        encoded, deepest = None, mine.agg(F.max("made")).first()[0]
        for k in range(1, deepest + 1):
            some = level if k == 1 else level.join(side.where(F.col("made") >= k).select("ord"), "ord", "left_semi")
            level = written(rasters.halved(some, edge, kind.dtype, method))
            named = level.join(side.select("path", "ord"), "ord").withColumn("level", F.lit(k))
            tiles_ = named.mapInArrow(_encoded_tiles(edge, kind.dtype, compression, predictor, kind.nodata, masked), sidecars.ROWS)
            encoded = tiles_ if encoded is None else encoded.unionByName(tiles_)
        bits = np.dtype(kind.dtype).itemsize * 8
        facts = F.to_json(F.struct(
            F.col("width"), F.col("height"), F.col("bands"), F.col("made").alias("levels"), F.lit(edge).alias("edge"), F.lit(masked).alias("masked"), F.lit(bits).alias("bits"), F.lit({"u": 1, "i": 2, "f": 3}[np.dtype(kind.dtype).kind]).alias("kind"),
            F.lit(compression).alias("codec"), F.lit(predictor).alias("predictor"), F.lit(None if kind.nodata is None else repr(kind.nodata)).cast("string").alias("nodata"),
        ), {"ignoreNullFields": "false"})
        zero = lambda t: F.lit(0).cast(t)
        heads = mine.select("path", zero("int").alias("role"), zero("int").alias("level"), zero("int").alias("band"), zero("long").alias("ty"), zero("long").alias("tx"), zero("long").alias("size"), facts.cast("binary").alias("data"))
        every = heads.unionByName(written(encoded))
        # tiles in the order of layout(): masks' levels after the others', the last directory first
        every = every.withColumn("late", F.when((F.col("role") == 2) & (F.col("band") == 0), -F.col("level") - 1000).otherwise(-F.col("level")))
        dealt = every.repartition("path").sortWithinPartitions("path", "role", "late", "band", "ty", "tx").drop("late")
        dealt.write.format("overviews").mode("append").save()
    made = todo.where("status = 'ok'").select("path", "width", "height", "made")
    wrong = made.mapInPandas(_sizes, "path string, wrong boolean").where("wrong").head(1)
    if wrong:
        raise InputError(f"{wrong[0].path}.ovr has not the levels that were asked for")
    return spark.createDataFrame(todo.select("path", "status", F.col("made").alias("levels")).orderBy("path").collect(), "path string, status string, levels int")


def _sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whether the directories of a file .ovr have other sizes than its raster's levels."""
    for frame in frames:
        out = []
        for path, width, height, made in frame.itertuples(index=False):
            store, name = files.opened(f"{path}.ovr")
            with store.open_input_file(name) as stream:
                found = [(d[256][0], d[257][0]) for d in geotiff.images(geotiff.directories(stream))[0]]
            out.append((path, found != [(-(-width // (1 << k)), -(-height // (1 << k))) for k in range(1, made + 1)]))
        yield pd.DataFrame(out, columns=["path", "wrong"])


class Job:
    """A function of the session that runs beside the caller: status, result, and cancel, which interrupts its Spark work."""

    def __init__(self, spark: SparkSession, work: Callable[[SparkSession], object]):
        self.spark, self.tag, self.value, self.error, self.stopped = spark, f"gridloom-{uuid.uuid4().hex}", None, None, False

        def run() -> None:
            spark.sparkContext.setJobGroup(self.tag, "gridloom job", interruptOnCancel=True)
            try:
                self.value = work(spark)
            except Exception as error:  # noqa: BLE001  handed to result()
                self.error = error

        self.thread = threading.Thread(target=run, daemon=True)
        self.thread.start()

    def status(self) -> str:
        if self.thread.is_alive():
            return "running"
        return "cancelled" if self.stopped and self.error else "failed" if self.error else "done"

    def cancel(self) -> None:
        self.stopped = True
        self.spark.sparkContext.cancelJobGroup(self.tag)

    def result(self, seconds: float | None = None):
        self.thread.join(seconds)
        if self.thread.is_alive():
            raise TimeoutError
        if self.error:
            raise self.error
        return self.value
