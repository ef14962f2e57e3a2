"""Blocks, regions, coverage and storage of outputs, from rectangles alone: no sample is read.

Rectangles are columns x, y, w, h with an id column; ranges are half open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.rects import coordinate
from gridloom.functions.ranks import running, uniform
from gridloom.functions.shared import written

#: Sample edge of a storage tile, what an empty one takes compressed, and the reserve on top of an estimate.
EDGE, EMPTY_TILE_BYTES, STORAGE_MARGIN = 512, 1024, 1.1


def _keys(size: int):
    """The squares of a key grid that a rectangle covers."""
    span = lambda a, n: F.sequence(F.floor(F.col(a) / size), F.floor((F.col(a) + F.col(n) - 1) / size))
    return F.flatten(F.transform(span("y", "h"), lambda ky: F.transform(span("x", "w"), lambda kx: F.struct(kx.alias("kx"), ky.alias("ky")))))


def overlap_pairs(rects: DataFrame, id_: str = "ord", key_size: int = 64) -> DataFrame:
    """(a, b, x, y, w, h) of each two rectangles that share area, a before b, with what they share.

    Equal keys bring neighbours together instead of a loop over all pairs; a pair counts in the one square
    that holds its common corner.
    """
    keyed = rects.where("w > 0 and h > 0").select(F.col(id_).alias("id"), "x", "y", "w", "h", F.explode(_keys(key_size)).alias("k"))
    a = keyed.select("k", *[F.col(c).alias(f"a_{c}") for c in ("id", "x", "y", "w", "h")])
    b = keyed.select("k", *[F.col(c).alias(f"b_{c}") for c in ("id", "x", "y", "w", "h")])
    x, y = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    w = F.least(F.expr("a_x + a_w"), F.expr("b_x + b_w")) - x
    h = F.least(F.expr("a_y + a_h"), F.expr("b_y + b_h")) - y
    met = a.join(b, "k").where("a_id < b_id").where((w > 0) & (h > 0))
    met = met.where((F.col("k.kx") == F.floor(x / key_size)) & (F.col("k.ky") == F.floor(y / key_size)))
    return met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def contributors(blocks: DataFrame, rects: DataFrame, key_size: int = 64) -> DataFrame:
    """(block, source, x, y, w, h): what each block (block, x, y, w, h) reads of each source (ord, x, y, w, h)."""
    a = blocks.select("block", "x", "y", "w", "h", F.explode(_keys(key_size)).alias("k")).select("k", "block", *[F.col(c).alias(f"a_{c}") for c in "xywh"])
    b = rects.select("ord", "x", "y", "w", "h", F.explode(_keys(key_size)).alias("k")).select("k", F.col("ord").alias("source"), *[F.col(c).alias(f"b_{c}") for c in "xywh"])
    x, y = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    w, h = F.least(F.expr("a_x + a_w"), F.expr("b_x + b_w")) - x, F.least(F.expr("a_y + a_h"), F.expr("b_y + b_h")) - y
    met = a.join(b, "k").where((w > 0) & (h > 0) & (F.col("k.kx") == F.floor(x / key_size)) & (F.col("k.ky") == F.floor(y / key_size)))
    return met.select("block", "source", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def _strips() -> tuple:
    """Of a rectangle (x0, y0, x1, y1): what lies outside of its whole squares of 64 by 64, as up to four rectangles, and those squares in units of 64."""
    up, down = (lambda c: F.shiftright(F.col(c) + 63, 6)), (lambda c: F.shiftright(F.col(c), 6))
    inner = (up("x0") < down("x1")) & (up("y0") < down("y1"))
    box = lambda *v: F.struct(*[c.alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), v, strict=True)])
    x0, y0, x1, y1 = map(F.col, ("x0", "y0", "x1", "y1"))
    left, low, right, high = up("x0") * 64, up("y0") * 64, down("x1") * 64, down("y1") * 64
    rim = F.array(box(x0, y0, x1, low), box(x0, high, x1, y1), box(x0, low, left, high), box(right, low, x1, high))
    return inner, F.when(inner, rim).otherwise(F.array(box(x0, y0, x1, y1))), box(up("x0"), up("y0"), down("x1"), down("y1"))


def union_area(rects: DataFrame, keys: list[str]) -> DataFrame:
    """Area of the union of each key's rectangles, whose sides are whole numbers.

    A rectangle becomes words of 64 bits, one for each 64 cells of each row that it covers, but for the squares of 64 by 64 that it fills:
    those are cells of the next level, where the same is done. Equal places of a key are joined by bitwise or, first in each task, so
    neither many rectangles of one key nor many copies of one meet anywhere; rows grow with the rims. Bits are counted where no higher level has filled their square.
    """
    part = rects.where("w > 0 and h > 0").select(*keys, *[F.expr(e).cast("long").alias(n) for n, e in (("x0", "x"), ("y0", "y"), ("x1", "x + w"), ("y1", "y + h"))])
    side = part.agg(F.max(F.least(F.expr("x1 - x0"), F.expr("y1 - y0")))).first()[0] or 0
    inner, rim, core = _strips()
    levels = []
    while True:
        cells = part.select(*keys, F.explode(rim).alias("r")).where("r.x0 < r.x1 and r.y0 < r.y1")
        cells = cells.select(*keys, "r", F.explode(F.sequence(F.shiftright("r.x0", 6), F.shiftright(F.col("r.x1") - 1, 6))).alias("sx"))
        first, last = F.greatest(F.col("r.x0") - F.col("sx") * 64, F.lit(0)), F.least(F.col("r.x1") - F.col("sx") * 64, F.lit(64))
        cells = cells.select(*keys, "sx", first.cast("int").alias("a"), last.cast("int").alias("b"), F.explode(F.sequence(F.col("r.y0"), F.col("r.y1") - 1)).alias("y"))
        bits = F.expr("case when b - a = 64 then -1L else shiftleft(shiftleft(1L, b - a) - 1L, a) end")
        levels.append(cells.groupBy(*keys, "sx", "y").agg(F.bit_or(bits).alias("bits")))
        if side < 64:
            break
        part, side = part.where(inner).select(*keys, core.alias("c")).select(*keys, "c.*"), side // 64
    total = None
    for k, level in enumerate(levels):
        for up in range(k + 1, len(levels)):
            # the square of a word's cells at the level above, and so on
            step = 6 * (up - k)
            names = [*keys, "px", "py"]
            higher = levels[up].select(*keys, F.col("sx").alias("px"), F.col("y").alias("py"), F.col("bits").alias("above"))
            level = level.withColumns({"px": F.shiftright("sx", step), "py": F.shiftright("y", step)}).join(higher, names, "left")
            at = F.expr(f"shiftright(sx, {step - 6}) & 63").cast("int")
            level = level.withColumn("at", at).where(F.expr("above is null or shiftrightunsigned(above, at) & 1 = 0")).select(*keys, "sx", "y", "bits")
        counted = level.groupBy(*keys).agg((F.sum(F.bit_count("bits").cast("long")) * F.lit(4096**k)).alias("area"))
        total = counted if total is None else total.unionByName(counted)
    return total if len(levels) == 1 else total.groupBy(*keys).agg(F.sum("area").alias("area"))


def coverage(sources: DataFrame, outputs: DataFrame, id_: str = "ord", key_size: int = 64) -> DataFrame:
    """(ord, area, covered): a source's area and what disjoint outputs hold of it; they are equal if nothing is lost."""
    named = outputs.select(F.col(id_).alias("block"), "x", "y", "w", "h")
    parts = contributors(named, sources.withColumnRenamed(id_, "ord") if id_ != "ord" else sources, key_size)
    got = parts.groupBy("source").agg(F.sum(F.col("w") * F.col("h")).alias("covered"))
    own = sources.select(F.col(id_).alias("ord"), (F.col("w") * F.col("h")).alias("area"))
    return own.join(got, F.col("ord") == F.col("source"), "left").select("ord", "area", F.coalesce("covered", F.lit(0)).alias("covered"))


def tile_blocks(tiles: DataFrame, size: int, minimum: int = 1, per_degree: int = 1, prefix: str = "BLOCK") -> DataFrame:
    """Blocks of size by size degrees over tiles (path, west, south): name, bounds, window, distinct tiles, eligible.

    Blocks start at -180 on both axes; latitude is clipped to the poles. The window is on a grid of
    per_degree samples whose nodes lie on whole degrees, edges shared.
    """
    floor = lambda c: -180 + F.floor((F.col(c) + 180) / size) * size
    made = tiles.groupBy(floor("west").alias("west"), floor("south").alias("origin")).agg(F.count_distinct("path").alias("tiles"))
    made = made.select("west", F.greatest(F.lit(-90), "origin").alias("south"), (F.col("west") + size).alias("east"), F.least(F.lit(90), F.col("origin") + size).alias("north"), "tiles")
    name = F.concat(F.lit(prefix + "_"), coordinate(F.col("south"), F.col("west")), F.lit("_"), coordinate(F.col("north") - 1, F.col("east") - 1))
    return made.select(
        name.alias("block"), "west", "south", "east", "north",
        ((F.col("west") + 180) * per_degree).alias("x"), ((90 - F.col("north")) * per_degree).alias("y"),
        ((F.col("east") - F.col("west")) * per_degree + 1).alias("w"), ((F.col("north") - F.col("south")) * per_degree + 1).alias("h"),
        "tiles", (F.col("tiles") >= minimum).alias("eligible"),
    )


def storage_estimate(blocks: DataFrame, parts: DataFrame, sources: DataFrame, overviews: bool = True) -> DataFrame:
    """Bytes of each block's output and scratch space, from the share of their sources' compressed bytes.

    blocks: block, w, h. parts: contributors(). sources: ord, base_bytes, pixels. Empty space costs small
    constant tiles, overviews the pixels that they add.
    """
    parts = parts.distinct()
    area = parts.groupBy("block", "source").agg(F.sum(F.col("w") * F.col("h")).alias("area"), F.count("*").alias("n"))
    share = area.join(sources.select(F.col("ord").alias("source"), "base_bytes", "pixels"), "source")
    bytes_ = share.groupBy("block").agg(F.ceil(F.sum(F.col("base_bytes") * F.least("area", "pixels") / F.col("pixels"))).alias("source_bytes"), F.sum("n").alias("seen"))
    held = union_area(parts, ["block"])
    rows = blocks.select("block", "w", "h").join(bytes_, "block", "left").join(held, "block", "left")
    pixels = F.col("w") * F.col("h")
    empty = F.greatest(F.lit(0), pixels - F.coalesce("area", F.lit(0)))
    tiles = F.ceil(F.col("w") / EDGE) * F.ceil(F.col("h") / EDGE)
    base = F.coalesce("source_bytes", F.lit(0)) + F.ceil(empty / (EDGE * EDGE)) * EMPTY_TILE_BYTES + tiles * 16 + 65536
    from gridloom.functions.rects import overview_sizes

    sizes = overview_sizes(F.col("w"), F.col("h")) if overviews else F.array()
    more = F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x["w"] * x["h"]) if overviews else F.lit(0)
    rows = rows.withColumn("output_bytes", F.ceil(base * (pixels + more) / pixels)).withColumn("levels", F.size(sizes))
    scratch = F.when(F.col("levels") > 0, F.ceil(F.col("output_bytes") / 3)).otherwise(0) + F.greatest(F.lit(65536), F.coalesce("seen", F.lit(0)) * 1024)
    rows = rows.withColumn("temporary_bytes", scratch)
    return rows.select("block", F.coalesce("source_bytes", F.lit(0)).alias("source_bytes"), "output_bytes", "temporary_bytes", F.ceil((F.col("output_bytes") + F.col("temporary_bytes")) * STORAGE_MARGIN).alias("reserved_bytes"))


#: Levels that one task takes a group of cells through: an even number, so that groups are square, with 2 ** GROUP_LEVELS cells at most.
GROUP_LEVELS = 12
PART = ["left", "top", "right", "bottom"]
GROWN = "kx long, ky long, left long, top long, right long, bottom long, done boolean"


def _grown(steps: int, target: int, first: bool, last: bool):
    """Cells (gx, gy, kx, ky and their part) sorted by group, joined by two along x and y in turn: done are those that fit and whose parent doesn't, or
    that have no parent; of each group its one cell goes on, as what is too large already keeps those around it from being chosen."""
    half = (1 << steps // 2) - 1
    bit = np.array([sum((i >> j & 1) << 2 * j for j in range(steps // 2)) for i in range(half + 1)])

    def fits(part):
        return part[2] - part[0] <= target // np.maximum(part[3] - part[1], 1)

    def joined(rows: pa.Table) -> pa.RecordBatch:
        gx, gy, kx, ky, *part = (c.to_numpy() for c in rows.columns)
        new = np.concatenate([[True], (gx[1:] != gx[:-1]) | (gy[1:] != gy[:-1])])
        code = np.cumsum(new) - 1 << steps | bit[kx & half] | bit[ky & half] << 1
        by = np.argsort(code)
        code, part = code[by], [c[by] for c in part]
        alive, done = np.ones(len(code), bool) if first else fits(part), []
        for _ in range(steps):
            code = code >> 1
            head = np.concatenate([[True], code[1:] != code[:-1]])
            at = np.flatnonzero(head)
            above = [f.reduceat(c, at) for f, c in zip((np.minimum, np.minimum, np.maximum, np.maximum), part, strict=True)]
            good = fits(above)
            out = alive & ~good[np.cumsum(head) - 1]
            done.append([c[out] for c in part])
            code, part, alive = code[at], above, good
        over = alive if last else np.ones(len(code), bool)
        ends = [np.concatenate([*(d[i] for d in done), part[i][over]]) for i in range(4)]
        settled = sum(len(d[0]) for d in done)
        at = [np.concatenate([np.zeros(settled, np.int64), g[new][over]]) for g in (gx, gy)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*at, *ends, np.arange(len(ends[0])) < settled + (len(ends[0]) if last else 0))], [c.split()[0] for c in GROWN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held).combine_chunks()
            gx, gy = rows.column("gx").to_numpy(), rows.column("gy").to_numpy()
            cut = np.flatnonzero((gx[1:] != gx[:-1]) | (gy[1:] != gy[:-1]))
            if len(cut):  # the last group may go on in the next batch
                yield joined(rows.slice(0, cut[-1] + 1))
                rows = rows.slice(cut[-1] + 1)
            held = rows.combine_chunks().to_batches()
        if held:
            yield joined(pa.Table.from_batches(held))

    return run


def regions(rects: DataFrame, target_pixels: int) -> DataFrame:
    """(ord, x, y, w, h): disjoint output rectangles of target_pixels at most that hold all source rectangles.

    Sources are cut at the squares of a fine grid. Squares halve in turn along x and y into ever larger cells; of the
    cells around a square the largest whose occupied part has at most target_pixels becomes an output, trimmed to that
    part. So empty space is never written, and where sources are sparse an output spans more. Outputs
    are numbered from the top, then from the left. A level's cells are made of those of the level below, so all levels
    together have at most twice the rows of the first where squares lie close, and no rectangle leaves the executors.
    """
    edge = max(1, math.isqrt(max(1, target_pixels)) // 8)
    found = rects.where("w > 0 and h > 0")
    far = found.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b")).first()
    if far.x is None:
        return rects.select(F.lit(0).cast("long").alias("ord"), *[F.col(c).cast("long").alias(c) for c in "xywh"]).limit(0)
    side = -(-max(far.r - far.x, far.b - far.y) // edge)
    levels = 2 * max(1, (side - 1).bit_length())
    at = found.select((F.col("x") - far.x).alias("x"), (F.col("y") - far.y).alias("y"), "w", "h")
    cut = at.select("x", "y", "w", "h", F.explode(_keys(edge)).alias("k")).select("k", *[
        f(F.col(a), k * edge).alias(b) for f, a, k, b in ((F.greatest, "x", F.col("k.kx"), "left"), (F.greatest, "y", F.col("k.ky"), "top"))
    ], F.least(F.col("x") + F.col("w"), (F.col("k.kx") + 1) * edge).alias("right"), F.least(F.col("y") + F.col("h"), (F.col("k.ky") + 1) * edge).alias("bottom"))
    bounds = [f(k).cast("long").alias(k) for f, k in zip((F.min, F.min, F.max, F.max), PART, strict=True)]
    squares = cut.groupBy(F.col("k.kx").cast("long").alias("kx"), F.col("k.ky").cast("long").alias("ky")).agg(*bounds)
    # A cell's part holds the parts of the cells in it, so once one is too large all around it are: what is chosen are the cells that fit whose parent doesn't.
    # A step takes a group of squares, or of the cells of the step before, through several levels in one task, and hands on one row of each group.
    cells, chosen, level = squares, None, 0
    while level < levels:
        steps = min(GROUP_LEVELS, levels - level)
        group = [F.shiftright(k, steps // 2).alias(g) for k, g in (("kx", "gx"), ("ky", "gy"))]
        dealt = cells.select(*group, "kx", "ky", *PART).repartition("gx", "gy").sortWithinPartitions("gx", "gy")
        grown = written(dealt.mapInArrow(_grown(steps, target_pixels, level == 0, level + steps == levels), GROWN))
        done = grown.where("done").select(*PART)
        chosen = done if chosen is None else chosen.union(done)
        cells, level = grown.where("not done").drop("done"), level + steps
    made = chosen.select((F.col("left") + far.x).alias("x"), (F.col("top") + far.y).alias("y"), (F.col("right") - F.col("left")).alias("w"), (F.col("bottom") - F.col("top")).alias("h"))
    return running(made, ["y", "x"], place="ord").select("ord", "x", "y", "w", "h")


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose (size, digest) differ between two listings, or that only one has."""
    a, b = before.select("path", F.struct("size", "sha256").alias("a")), after.select("path", F.struct("size", "sha256").alias("b"))
    return a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("path")


def set_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that one side alone has, with `side` missing or unexpected; empty if the sets are equal."""
    return expected.exceptAll(actual).withColumn("side", F.lit("missing")).union(actual.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def largest_reservations(estimates: DataFrame, workers: int) -> DataFrame:
    """What the largest concurrent reservations take together."""
    return estimates.orderBy(F.desc("reserved_bytes")).limit(workers).agg(F.sum("reserved_bytes").alias("reserved_bytes"))


def oversized(outputs: DataFrame, limit: int) -> DataFrame:
    """Outputs of more than a tenth above the limit of bytes, with how many parts each should be split into."""
    return outputs.where(F.col("bytes") > F.floor(F.lit(limit) * 11 / 10)).withColumn("parts", F.ceil(F.col("bytes") / limit))


def density(windows: DataFrame, sampled: int = 8, seed: int = 1) -> DataFrame:
    """(source, bytes_per_pixel): what compression leaves of each source, from some of its windows.

    windows: source, window, bytes, pixels. A hash of seed, source and window picks them.
    """
    pick = Window.partitionBy("source").orderBy(uniform(seed, F.col("source"), F.col("window")), "window")
    some = windows.withColumn("i", F.row_number().over(pick)).where(F.col("i") <= sampled)
    return some.groupBy("source").agg((F.sum("bytes") / F.sum("pixels")).alias("bytes_per_pixel"))


def resumption(plan: DataFrame, state: DataFrame, files: DataFrame) -> DataFrame:
    """(block, status) of a job's blocks: done, if its file is as the state says (bytes and sha256), else pending, if nothing is there, else again;
    unexpected, if the plan hasn't it. A block of several rows of state is done if its file is as one of them says."""
    same = state.join(files, ["block", "bytes", "sha256"], "left_semi").select("block").distinct().withColumn("same", F.lit(True))
    known = state.select("block").union(files.select("block")).distinct().withColumn("known", F.lit(True))
    rows = plan.select("block").distinct().withColumn("planned", F.lit(True)).join(known, "block", "full_outer").join(same, "block", "left")
    status = F.when(F.col("planned").isNull(), "unexpected").when(F.col("same"), "done").when(F.col("known"), "again").otherwise("pending")
    return rows.select("block", status.alias("status"))
