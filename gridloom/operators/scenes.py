"""Selection of scenes for a mosaic: the best of each tile, and a greedy cover of the area."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.functions import polygons
from gridloom.functions.shared import spread, written


def best_per_tile(products: DataFrame, share: float = 0.999) -> DataFrame:
    """Of each tile's online products with `share` of its best area: the least cloudy, then newest, then by id.

    products: tile_id, id, cloud_cover, acquired, area, online.
    """
    online = products.where("online and area > 0")
    most = online.groupBy("tile_id").agg(F.max("area").alias("most"))
    near = online.join(most, "tile_id").where(F.col("area") >= F.col("most") * share)
    best = F.min(F.struct("cloud_cover", (-F.unix_timestamp("acquired")).alias("age"), "id", "acquired", "area"))
    return near.groupBy("tile_id").agg(best.alias("b")).select("tile_id", "b.id", "b.cloud_cover", "b.acquired", "b.area")


def mosaic_order(products: DataFrame) -> DataFrame:
    """High cloud first, so that the clearest scene is last and wins; then date, then id."""
    return products.orderBy(F.desc("cloud_cover"), "acquired", "id")


class Uncovered(ValueError):
    """A catalogue that covers too little of the area."""


#: Scenes whose footprints the driver may hold to take several steps between two passes over the table.
AHEAD = 256
#: Shares of the area of interest that are the same but for rounding.
TIE = 1e-12
_RING = "array<struct<x double, y double>>"


def _rings(products: DataFrame) -> DataFrame:
    """products with `ring`: their footprint, or their box where they have none."""
    if "ring" in products.columns:
        return products.withColumn("ring", F.col("ring").cast(_RING))
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"))
    return products.withColumn("ring", F.when((F.col("west") < F.col("east")) & (F.col("south") < F.col("north")), ring).otherwise(F.array().cast(_RING)))


def _ring(aoi) -> polygons.Ring:
    if len(aoi) == 4 and not hasattr(aoi[0], "__len__"):
        west, south, east, north = map(float, aoi)
        return [(west, south), (east, south), (east, north), (west, north)]
    return [(float(x), float(y)) for x, y in aoi]


def _shared(rows: DataFrame, pieces: list[polygons.Ring], name: str) -> DataFrame:
    """rows with the area that their ring shares with disjoint convex pieces; the pieces go to every task."""
    sent = rows.sparkSession.sparkContext.broadcast((pieces, [polygons.bounds(p) for p in pieces]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            open_, boxes = sent.value
            rings = [tuple((p["x"], p["y"]) for p in ring) if ring is not None else () for ring in frame["ring"]]
            areas = {r: float(polygons.shared(open_, boxes, polygons.convex_parts(list(r)))) for r in set(rings)}
            yield frame.assign(**{name: [areas[r] for r in rings]})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def inside(products: DataFrame, aoi) -> DataFrame:
    """products with `area`, what their footprint (column ring, points x and y, or west, south, east, north) has of the area of interest, for `best_per_tile`.

    aoi: a ring of points, or west, south, east, north. Rings are simple, convex or not, of either turn. Rows that only touch it have 0.
    """
    return _shared(_rings(products), polygons.convex_parts(_ring(aoi)), "area")


def greedy_cover(products: DataFrame, aoi, most: int = 100, enough: float = 0.9999, least: float = 1e-5, fallback: float = 1e-6, required: float = 0.0) -> DataFrame:
    """(step, id, gain): scenes by the area that each adds to an area of interest, a ring or west, south, east, north.

    products: id, cloud_cover, ring (points x and y) or west, south, east, north and, where there are several acquisitions of a tile,
    best (boolean: the tile's best one) and acquired. The best ones come first, each time that of the largest gain, ties by cloud, then id, while it
    adds `least` of the area; then others, of those within 99 % of the largest gain the least cloudy, newest, by id,
    while that is `fallback` of the area. It ends at `enough` of the area or `most` scenes, and fails below `required`.

    Scenes stay in a table, one of each ring. What is still open is a list of disjoint convex pieces, cut by each scene taken and bounded by those. A pass over the table
    gives every scene's gain; gains only fall from then on, so among the AHEAD scenes that gained most the driver takes steps for itself as long as what
    it takes beats the gain of all others then, and only then asks for another pass.
    """
    spark = products.sparkSession
    whole = _ring(aoi)
    open_ = polygons.convex_parts(whole)
    total, chosen = sum(polygons.area(t) for t in open_), []
    more = [c for c in ("best", "acquired") if c in products.columns]
    scenes = _rings(products).select(F.col("id").cast("string").alias("id"), F.col("cloud_cover").cast("double").alias("cloud_cover"), *more, "ring")
    scenes = scenes.withColumns({"best": F.col("best") if "best" in more else F.lit(True), "age": -F.unix_timestamp("acquired") if "acquired" in more else F.lit(0).cast("long")})
    # of scenes with one ring only the first in either order can be taken: the others add nothing after it
    own = [] if least > 0 and fallback > 0 else ["id"]
    facts = {True: F.struct("cloud_cover", "id", "age"), False: F.struct("cloud_cover", "age", "id")}
    scenes = scenes.groupBy("ring", *own).agg(F.min(F.when(F.col("best"), facts[True])).alias("first"), F.min(facts[False]).alias("any")).select("ring", "first", "any")
    scenes = written(_shared(spread(scenes), open_, "all").where(F.col("all") > 0))

    def covered() -> float:
        return total - sum(abs(polygons.area(p)) for p in open_)

    for first, stop in ((True, least), (False, fallback)):
        ended = False
        while not ended and len(chosen) < most and covered() < total * enough:
            rest = scenes.select(F.col("first" if first else "any").alias("s"), "ring").where("s is not null").select("s.id", "s.cloud_cover", "s.age", "ring")
            rest = rest.where(~F.col("id").isin([c[1] for c in chosen]))
            top = _shared(rest, open_, "gain").orderBy(F.desc("gain"), "cloud_cover", "id").limit(AHEAD + 1).collect()
            bound = top.pop().gain if len(top) > AHEAD else -1.0  # no scene outside has more
            ahead = [(r.id, r.cloud_cover, r.age, polygons.convex_parts([(p.x, p.y) for p in r.ring])) for r in top]
            moved = False
            while len(chosen) < most and covered() < total * enough:
                boxes = [polygons.bounds(p) for p in open_]
                gains = [(polygons.shared(open_, boxes, parts), *facts, parts) for *facts, parts in ahead]
                best = max((g[0] for g in gains), default=0.0)
                if best < total * stop and bound < total * stop:
                    ended = True
                    break
                # a scene outside could tie or be near enough; right after a pass those with more are all here
                if bound >= (best - total * TIE if first else best * 0.99) and (moved or not first and bound >= best * 0.99 and len(top) == AHEAD):
                    break
                pick = min(gains, key=lambda g: (-round(g[0] / total / TIE), g[2], g[1])) if first else min((g for g in gains if g[0] >= best * 0.99), key=lambda g: (g[2], g[3], g[1]))
                chosen.append((len(chosen), pick[1], pick[0]))
                open_ = [p for p in polygons.without(open_, pick[4]) if abs(polygons.area(p)) > total * 1e-15]
                ahead, moved = [a for a in ahead if a[0] != pick[1]], True
            if not moved and not ended:
                # more scenes than AHEAD are within 99 % of the largest gain: the table picks among them
                best = top[0].gain
                near = _shared(rest, open_, "gain").where(F.col("gain") >= best * 0.99).orderBy("cloud_cover", "age", "id").first()
                chosen.append((len(chosen), near.id, near.gain))
                open_ = [p for p in polygons.without(open_, polygons.convex_parts([(p.x, p.y) for p in near.ring])) if abs(polygons.area(p)) > total * 1e-15]
    if not total or covered() < total * required:
        raise Uncovered(f"the scenes cover {covered() / total if total else 0:.2%} of the area")
    return spark.createDataFrame(chosen, "step int, id string, gain double")
