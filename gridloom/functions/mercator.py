"""Web Mercator: projection, tiles of zoom levels, metatiles, request addresses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half the width of the projected world in metres.
HALF = math.pi * 6378137.0


def forward(lon: Column, lat: Column) -> Column:
    """Longitude and latitude in degrees to metres (x, y)."""
    return F.struct((HALF * lon / 180).alias("x"), (HALF * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) / math.pi).alias("y"))


def tile_width(z: Column) -> Column:
    return 2 * HALF / F.pow(F.lit(2.0), z)


def tile_bbox(z: Column, x: Column, y: Column) -> Column:
    width = tile_width(z)
    return F.struct((-HALF + x * width).alias("west"), (HALF - (y + 1) * width).alias("south"), (-HALF + (x + 1) * width).alias("east"), (HALF - y * width).alias("north"))


def view_tiles(z: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Tiles (z, x, y) of a view in row order; a view that ends on a tile's edge doesn't reach the next."""
    width = tile_width(z)
    left, right = F.floor((west + HALF) / width), F.floor((east + HALF - 1e-6) / width)
    top, bottom = F.floor((HALF - north) / width), F.floor((HALF - south - 1e-6) / width)
    row = lambda y: F.transform(F.sequence(left, right), lambda x: F.struct(z.alias("z"), x.alias("x"), y.alias("y")))
    return F.flatten(F.transform(F.sequence(top, bottom), row))


def tile_of(lon: Column, lat: Column, z: Column) -> Column:
    """The tile (x, y) that holds a place, rows counted from the north."""
    n = F.pow(F.lit(2.0), z)
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n)
    last = F.floor(n) - 1
    return F.struct(F.least(F.greatest(x, F.lit(0)), last).alias("x"), F.least(F.greatest(y, F.lit(0)), last).alias("y"))


def flipped_row(z: Column, y: Column) -> Column:
    """Rows counted from the other pole (TMS and XYZ)."""
    return F.floor(F.pow(F.lit(2.0), z)) - 1 - y


def metatile(x: Column, y: Column, size: int = 4) -> Column:
    return F.struct(F.floor(x / size).alias("x"), F.floor(y / size).alias("y"))


def view_bbox(lon: Column, lat: Column, z: Column, width: int, height: int, tile: int = 256) -> Column:
    """The box of a view of so many pixels around a place."""
    at, step = forward(lon, lat), tile_width(z) / tile
    return F.struct(
        (at["x"] - step * width / 2).alias("west"), (at["y"] - step * height / 2).alias("south"), (at["x"] + step * width / 2).alias("east"), (at["y"] + step * height / 2).alias("north")
    )


def query_string(**values: Column | str | int) -> Column:
    """KEY=value&..., values encoded."""
    parts = [F.concat(F.lit(k + "="), F.url_encode(v.cast("string") if isinstance(v, Column) else F.lit(str(v)))) for k, v in values.items()]
    return F.concat_ws("&", *parts)


def wmts_url(base: str, layer: Column, fmt: str, z: Column, x: Column, y: Column, matrix: str = "EPSG:900913") -> Column:
    query = query_string(
        SERVICE="WMTS", VERSION="1.0.0", REQUEST="GetTile", LAYER=layer, STYLE="", FORMAT=fmt, TILEMATRIXSET=matrix, TILEMATRIX=F.concat(F.lit(matrix + ":"), z.cast("string")), TILEROW=y, TILECOL=x
    )
    return F.concat(F.lit(base + "?"), query)


def wms_url(base: str, layer: Column, bbox: Column, width: int, height: int, fmt: str = "image/png", crs: str = "EPSG:3857") -> Column:
    box = F.concat_ws(",", *[bbox[k].cast("string") for k in ("west", "south", "east", "north")])
    return F.concat(F.lit(base + "?"), query_string(SERVICE="WMS", VERSION="1.1.1", REQUEST="GetMap", LAYERS=layer, STYLES="", SRS=crs, BBOX=box, WIDTH=width, HEIGHT=height, FORMAT=fmt))


#: Names of the projected grid that map servers use for one and the same.
EQUIVALENT = ("EPSG:900913", "EPSG:3857", "GoogleMapsCompatible")


def advertised(layers: Column, layer: Column, fmt: Column) -> Column:
    """The matrix set in which capabilities (layers: array of name, formats, matrix_sets) offer a layer in a format on a
    Web Mercator grid, by the order of EQUIVALENT; null where they don't."""
    fits = F.filter(layers, lambda x: (x["name"] == layer) & F.array_contains(x["formats"], fmt))
    sets = F.flatten(F.transform(fits, lambda x: x["matrix_sets"]))
    return F.get(F.filter(F.array(*[F.lit(x) for x in EQUIVALENT]), lambda x: F.array_contains(sets, x)), F.lit(0))


def point_text(x: Column, y: Column) -> Column:
    """A label's place as well-known text; null unless both are there."""
    return F.when(x.isNotNull() & y.isNotNull(), F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")")))
