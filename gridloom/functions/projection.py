"""Transverse Mercator as column expressions, rectangles carried over to another system, areas of rings."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import mercator


@dataclass(frozen=True)
class Transverse:
    """A transverse Mercator system: longitude and latitude of its origin in degrees, scale, false origin in metres, ellipsoid."""

    lon0: float
    lat0: float = 0.0
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0
    axis: float = 6378137.0
    flattening: float = 1 / 298.257223563

    @property
    def n(self) -> float:
        return self.flattening / (2 - self.flattening)

    @property
    def radius(self) -> float:
        """Of the circle as long as a meridian, scaled."""
        n = self.n
        return self.scale * self.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def origin(self) -> float:
        """How far along the meridian the origin lies, scaled."""
        if not self.lat0:
            return 0.0
        s, e = math.sin(math.radians(self.lat0)), math.sqrt(self.flattening * (2 - self.flattening))
        xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
        return self.radius * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(forward_terms(self.n), 1)))


def forward_terms(n: float) -> list[float]:
    """Krueger's series in the third flattening, to the fourth order, from conformal to rectifying latitude. Fixed values."""
    return [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]


def inverse_terms(n: float) -> list[float]:
    """The same from rectifying to conformal latitude. Fixed values."""
    return [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]


def latitude_terms(n: float) -> list[float]:
    """The same from conformal to geodetic latitude. Fixed values."""
    return [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]


def utm(code: int) -> Transverse:
    """The zone of EPSG:326zz (north) or 327zz (south)."""
    family, zone = divmod(code, 100)
    if family not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"EPSG:{code} is no UTM zone")
    return Transverse(6.0 * zone - 183, north=0.0 if family == 326 else 10_000_000.0)


def _sum(terms: list[float], each) -> Column:
    out = F.lit(0.0)
    for j, t in enumerate(terms, 1):
        out = out + F.lit(t) * each(2.0 * j)
    return out


def to_grid(lon: Column, lat: Column, system: Transverse) -> Column:
    """Degrees to metres (x, y), to well under a millimetre within some 20 degrees of the meridian."""
    e = math.sqrt(system.flattening * (2 - system.flattening))
    s, away = F.sin(F.radians(lat)), F.radians(lon - system.lon0)
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    terms = forward_terms(system.n)
    north = xi + _sum(terms, lambda j: F.sin(xi * j) * F.cosh(eta * j))
    east = eta + _sum(terms, lambda j: F.cos(xi * j) * F.sinh(eta * j))
    return F.struct((system.east + F.lit(system.radius) * east).alias("x"), (system.north - system.origin() + F.lit(system.radius) * north).alias("y"))


def _stages(system: Transverse) -> list:
    """Metres to degrees in steps from struct to struct, so that what one makes the next reads as fields, not as expressions again."""
    terms = inverse_terms(system.n)
    return [
        lambda p: F.struct(((p["y"] - system.north + system.origin()) / F.lit(system.radius)).alias("u"), ((p["x"] - system.east) / F.lit(system.radius)).alias("v")),
        lambda p: F.struct((p["u"] - _sum(terms, lambda j: F.sin(p["u"] * j) * F.cosh(p["v"] * j))).alias("xi"), (p["v"] - _sum(terms, lambda j: F.cos(p["u"] * j) * F.sinh(p["v"] * j))).alias("eta")),
        lambda p: F.struct(F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])).alias("chi"), F.degrees(F.atan2(F.sinh(p["eta"]), F.cos(p["xi"]))).alias("away")),
        lambda p: F.struct((p["away"] + system.lon0).alias("x"), F.degrees(p["chi"] + _sum(latitude_terms(system.n), lambda j: F.sin(p["chi"] * j))).alias("y")),
    ]


def from_grid(x: Column, y: Column, system: Transverse) -> Column:
    """Metres to degrees (x: longitude, y: latitude)."""
    return F.get(geographic(F.array(F.struct(x.alias("x"), y.alias("y"))), system), F.lit(0))


def geographic(ring: Column, system: Transverse) -> Column:
    """A ring of a system's metres in degrees."""
    for stage in _stages(system):
        ring = F.transform(ring, stage)
    return ring


def densified(west: Column, south: Column, east: Column, north: Column, steps: int = 20) -> Column:
    """The ring of a rectangle with `steps` + 1 points to each edge, counter-clockwise from the south-west, corners twice: straight edges bend in another system."""
    def edge(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
        at = lambda i, k: a[k] + (b[k] - a[k]) * i / steps
        return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y")))

    corners = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    return F.flatten(F.array(*[edge(a, b) for a, b in zip(corners, corners[1:], strict=False)]))


def inscribed(west: Column, south: Column, east: Column, north: Column, system: Transverse) -> Column:
    """The Web Mercator rectangle inside the carried-over corners of a rectangle: (west, south, east, north), which requests keep to."""

    def corner(x: Column, y: Column) -> Column:
        at = from_grid(x, y, system)
        return mercator.forward(at["x"], at["y"])

    nw, ne, sw, se = corner(west, north), corner(east, north), corner(west, south), corner(east, south)
    return F.struct(F.greatest(nw["x"], sw["x"]).alias("west"), F.greatest(sw["y"], se["y"]).alias("south"), F.least(ne["x"], se["x"]).alias("east"), F.least(nw["y"], ne["y"]).alias("north"))


def ring_area(ring: Column) -> Column:
    """The area inside a ring of points (x, y), closed or not; points count from the first, which keeps digits."""
    first = F.get(ring, F.lit(0))
    moved = F.transform(ring, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))
    pairs = F.zip_with(moved, F.slice(moved, F.lit(2), F.greatest(F.size(moved) - 1, F.lit(0))), lambda a, b: F.coalesce(a["x"] * b["y"] - b["x"] * a["y"], F.lit(0.0)))
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)) / 2
