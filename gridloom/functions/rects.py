"""Rectangles, affine grids and sample indices as Column expressions.

A rectangle is a struct (x, y, w, h) of half-open pixel ranges; a grid is a struct (c, a, b, f, d, e) with
x = c + col * a + row * b and y = f + col * d + row * e.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def rect(x, y, w, h) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(k) if not isinstance(v, (str, Column)) else (F.col(v) if isinstance(v, str) else v).cast("long").alias(k) for k, v in zip("xywh", (x, y, w, h), strict=True)])


def intersection(a: Column, b: Column) -> Column:
    """The common rectangle, or null where edges only touch."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - x
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - y
    return F.when((w > 0) & (h > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def meets(a: Column, b: Column) -> Column:
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])


def area(r: Column) -> Column:
    return r["w"] * r["h"]


def within(r: Column, parent: Column) -> Column:
    """The rectangle in its parent's pixels."""
    return F.struct((r["x"] - parent["x"]).alias("x"), (r["y"] - parent["y"]).alias("y"), r["w"].alias("w"), r["h"].alias("h"))


def enclosing(x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> Column:
    """Aggregate: the smallest rectangle around all."""
    left, top = F.min(x), F.min(y)
    return F.struct(left.alias("x"), top.alias("y"), (F.max(F.col(x) + F.col(w)) - left).alias("w"), (F.max(F.col(y) + F.col(h)) - top).alias("h"))


def located(grid: Column, col, row) -> Column:
    """Map coordinates of a pixel position; add a half for centres."""
    col, row = (v if isinstance(v, Column) else F.lit(v) for v in (col, row))
    return F.struct((grid["c"] + col * grid["a"] + row * grid["b"]).alias("x"), (grid["f"] + col * grid["d"] + row * grid["e"]).alias("y"))


def shifted(grid: Column, col, row) -> Column:
    """The same grid anchored at another pixel."""
    at = located(grid, col, row)
    return F.struct(at["x"].alias("c"), *[grid[k].alias(k) for k in "ab"], at["y"].alias("f"), *[grid[k].alias(k) for k in "de"])


def snapped(value: Column) -> Column:
    """A whole number where division left a few units in the last place, else the value."""
    near = F.rint(value)
    return F.when(F.abs(value - near) <= 4 * EPSILON * F.greatest(F.lit(1.0), F.abs(value)), near).otherwise(value)


def whole(value: Column, tolerance: float) -> Column:
    """Whether a value is an integer within a tolerance; each kind of input has a tolerance of its own."""
    return F.abs(value - F.rint(value)) <= tolerance


def output_footprint(r: Column, extent: Column, rx, ry) -> Column:
    """A source rectangle in the pixels of a coarser grid anchored at the extent: floored and ceiled."""
    x, y = F.floor(snapped((r["x"] - extent["x"]) / rx)), F.floor(snapped((r["y"] - extent["y"]) / ry))
    right = F.ceil(snapped((r["x"] + r["w"] - extent["x"]) / rx))
    bottom = F.ceil(snapped((r["y"] + r["h"] - extent["y"]) / ry))
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h"))


def nearest_index(i: Column, ratio, origin=0, size=None) -> Column:
    """The source index under an output cell's centre."""
    at = F.lit(origin) + (i + 0.5) * ratio
    return F.floor(F.least(at, F.lit(origin) + size) if size is not None else at)


def overview_index(i: Column, ratio) -> Column:
    return F.floor(0.5 + i * ratio)


def post_column(local: Column, factor: Column) -> Column:
    """The source column of a post on a grid `factor` times finer; a midpoint goes east."""
    return F.floor((2 * local + factor) / (2 * factor))


def coordinate(lat: Column, lon: Column) -> Column:
    """N30E020 and the like."""
    ns, ew = F.when(lat >= 0, "N").otherwise("S"), F.when(lon >= 0, "E").otherwise("W")
    return F.concat(ns, F.lpad(F.abs(lat).cast("string"), 2, "0"), ew, F.lpad(F.abs(lon).cast("string"), 3, "0"))


def overview_sizes(width: Column, height: Column, least: int = 512, levels: int = 24) -> Column:
    """Sizes of a pyramid: ceil-halved until neither side is over `least`."""
    power = lambda k: F.floor(F.pow(F.lit(2.0), k))
    size = lambda v, k: F.floor((v + power(k) - 1) / power(k))
    made = F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda k: F.struct(k.alias("level"), size(width, k).alias("w"), size(height, k).alias("h")))
    above = lambda k: F.greatest(size(width, k - 1), size(height, k - 1)) > least
    return F.filter(made, lambda s: above(s["level"]))


def overview_factors(width: Column, height: Column, levels: int = 24) -> Column:
    """Powers of two down to one pixel, those left out that give a size again."""
    wide = F.greatest(width, height)
    return F.filter(F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda k: F.floor(F.pow(F.lit(2.0), k))), lambda f: f / 2 < wide)
