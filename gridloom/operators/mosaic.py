"""Mosaics of samples: priority, ordered overwriting, ranked posts; overlaps, conflicts and verification.

Samples are rows (src, ord, band, x, y, v, valid): `ord` is any orderable value that places sources, one per
source and cell. A numeric `ord` keeps the aggregates in hash form; a struct sorts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from gridloom.functions.ranks import running
from gridloom.functions.shared import written
from gridloom.operators.tiles import _runs

CELL = ["band", "x", "y"]


def valid_sample(v: Column, nodata: Column) -> Column:
    """Whether a sample is none of the missing-data value, NaN being equal to NaN; a null value means all are valid."""
    return nodata.isNull() | F.when(F.isnan(nodata), ~F.isnan(v)).otherwise(v != nodata)


def valid_tuple(values: Column, sentinel: Column) -> Column:
    """A pixel is missing only if every band has its sentinel."""
    return ~F.forall(F.zip_with(values, sentinel, lambda a, b: F.when(F.isnan(b), F.isnan(a)).otherwise(a == b)), lambda x: x)


def non_finite(cells: DataFrame) -> DataFrame:
    """The first valid sample of each band that is NaN or infinite; statistics and averages refuse such input."""
    bad = cells.where(F.col("valid") & (F.isnan("v") | (F.abs("v") == float("inf"))))
    return bad.groupBy("band").agg(F.min(F.struct("y", "x")).alias("first"), F.count("*").alias("n")).select("band", F.col("first.y").alias("y"), F.col("first.x").alias("x"), "n")


def compose(cells: DataFrame, policy: str = "last") -> DataFrame:
    """(band, x, y, v): the valid sample of the first or last source; invalid samples never win.

    policy `error` raises where valid samples differ, and is `last` otherwise.
    """
    pick = {"first": F.min_by, "last": F.max_by, "error": F.max_by}[policy]
    made = cells.where("valid").groupBy(*CELL).agg(pick("v", "ord").alias("v"), F.min("v").alias("low"), F.max("v").alias("high"))
    if policy == "error":
        clash = F.raise_error(F.format_string("conflicting samples in band %d at %d, %d", F.col("band"), F.col("x"), F.col("y")))
        made = made.withColumn("v", F.when(F.col("low") == F.col("high"), F.col("v")).otherwise(clash.cast("double")))
    return made.select(*CELL, "v")


def overwrite(cells: DataFrame) -> DataFrame:
    """(band, x, y, v, valid): the last source's sample, missing ones included, as plain sources without NoData do.

    With columns skip_nodata or use_mask, sources that have either set are only taken where valid.
    """
    if "skip_nodata" in cells.columns or "use_mask" in cells.columns:
        flags = [F.col(c) for c in ("skip_nodata", "use_mask") if c in cells.columns]
        careful = F.coalesce(flags[0], F.lit(False)) if len(flags) == 1 else F.coalesce(flags[0], F.lit(False)) | F.coalesce(flags[1], F.lit(False))
        cells = cells.where(~careful | F.col("valid"))
    made = cells.groupBy(*CELL).agg(F.max_by(F.struct("v", "valid"), "ord").alias("s"))
    return made.select(*CELL, "s.v", "s.valid")


def ranked(posts: DataFrame) -> DataFrame:
    """(band, x, y, v, rank): the valid post of least rank, the earlier source's among equals."""
    made = posts.where("valid").groupBy(*CELL).agg(F.min_by(F.struct("v", "rank"), F.struct("rank", "ord")).alias("s"))
    return made.select(*CELL, "s.v", "s.rank")


def first_posts(posts: DataFrame) -> DataFrame:
    """One valid post of each place and factor, the earliest: no other of them can win, so the rest needn't be expanded."""
    made = posts.where("valid").groupBy(*CELL, "factor").agg(F.min_by("v", "ord").alias("v"), F.min("ord").alias("ord"))
    return made.select(F.lit(0).cast("long").alias("src"), "ord", *CELL, "v", F.lit(True).alias("valid"), "factor")


def native_conflicts(posts: DataFrame) -> DataFrame:
    """Cells where original posts (rank 0) of sources disagree, which abort a ranked mosaic."""
    native = posts.where("valid and rank = 0").groupBy(*CELL).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return native.where("low <> high")


def validity_union(cells: DataFrame) -> DataFrame:
    """(band, x, y, valid): whether any source has a valid sample."""
    return cells.groupBy(*CELL).agg(F.bool_or("valid").alias("valid"))


def uncovered(cells: DataFrame, width: int, height: int) -> DataFrame:
    """(band, x, y) of the grid's cells without any valid sample, for the bands that there are: what each row of a band lacks of 0 to width."""
    rows = cells.select("band").distinct().withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))))
    inside = F.col("valid") & F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    have = cells.where(inside).select("band", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).groupBy("band", "y").agg(F.collect_set("x").alias("xs"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))
    missing = F.when(F.col("xs").isNull(), every).otherwise(F.array_except(every, "xs"))
    return rows.join(have, ["band", "y"], "left").select("band", F.explode(missing).alias("x"), "y")


#: Sources of a block: each two blocks meet in a task, which holds what there is to say of each pair.
BLOCK = 2000
#: Blocks up to which each sample is copied to every block.
COPIES = 4
#: Samples of a packed piece of a block; blocks are made to have half as many.
PIECE = 2_000_000
#: Samples of two blocks that meet in one task; beyond it their places are dealt to several.
ZONE = 8_000_000
#: Pairs of samples that a task has in hand at once.
AT_ONCE = 2_000_000


def _known(column: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
    """Values in their own type (whole numbers with nulls would become floats) and which of them are not null; None: all."""
    known = np.asarray(column.is_valid()) if column.null_count else None
    if known is not None:
        column = column.fill_null(column.drop_null()[0]) if known.any() else pa.array(np.zeros(len(column)))
    return column.to_numpy(zero_copy_only=False), known


def _meetings(size: int, kinds: StructType):
    """A task over rows (lo, hi, zone, tile, place, src, at, v, value) sorted by the first four: of each two sources of blocks lo and hi what they share."""

    def first_common(mine: list, others: list, word: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Whether a band is the first of those that both sources have at the pixel."""
        out, none = np.zeros(len(bit), bool), np.ones(len(bit), bool)
        for k, (a, b) in enumerate(zip(mine, others, strict=True)):
            both = a & b
            out |= none & (word == k) & (bit == (both & -both))
            none &= both == 0
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, srcs = None, None, None

        def made():
            n, pixels, off, best, first, second = held
            found = np.flatnonzero(n)
            for k in range(0, len(found), 1 << 18):
                i = found[k : k + (1 << 18)]
                none = off[i] == 0
                columns = [srcs[0][i // size], srcs[1][i % size], pixels[i], n[i], off[i]]
                arrays = [pa.array(c, t) for c, t in zip(columns, types[:5], strict=True)] + [pa.array(c[i], t, mask=none) for c, t in zip((best, first, second), types[5:], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

        types, names = [f.type for f in to_arrow_schema(kinds)], kinds.names
        for (lo, hi, zone, _), rows in _runs(batches, ["lo", "hi", "zone", "tile"]):
            place, at = rows.column("place").to_numpy(), rows.column("at").to_numpy()
            src, v = (rows.column(c).to_numpy() for c in ("src", "v"))
            value, known = _known(rows.column("value").combine_chunks())
            if (lo, hi, zone) != key:
                if key is not None:
                    yield from made()
                key = (lo, hi, zone)
                held = [np.zeros(size * size, np.int64) for _ in range(3)] + [np.full(size * size, np.iinfo(np.int64).max), np.zeros(size * size, v.dtype), np.zeros(size * size, v.dtype)]
                srcs = [np.zeros(size, src.dtype), np.zeros(size, src.dtype)]
            n, pixels, off, best, first, second = held
            # the bands of each source and pixel as bits, 63 to a word
            bands, rank = np.unique(at & 255, return_inverse=True)
            word, bit = rank // 63, np.int64(1) << (rank % 63).astype(np.int64)
            _, spot = np.unique(np.stack([place, at >> 8]), axis=1, return_inverse=True)
            masks = []
            for k in range(-(-len(bands) // 63)):
                whole = np.zeros(spot.max() + 1, np.int64)
                np.bitwise_or.at(whole, spot, np.where(word == k, bit, 0))
                masks.append(whole[spot])
            # from the last place to the first, so that of several values for a pair the one of the first place is set last
            a = np.flatnonzero(place // size == lo)
            a = a[np.argsort(-at[a], kind="stable")]
            b = np.flatnonzero(place // size == hi)
            b = b[np.argsort(at[b], kind="stable")]
            srcs[0][place[a] % size], srcs[1][place[b] % size] = src[a], src[b]
            start, stop = np.searchsorted(at[b], at[a], "left"), np.searchsorted(at[b], at[a], "right")
            sums = np.cumsum(stop - start)
            cuts = [0]
            while cuts[-1] < len(a):
                done = sums[cuts[-1] - 1] if cuts[-1] else 0
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(sums, done + AT_ONCE, "right"))))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                many = stop[i:j] - start[i:j]
                ia = np.repeat(a[i:j], many)
                ib = b[np.arange(len(ia)) + np.repeat(start[i:j] - (np.cumsum(many) - many), many)]
                if lo == hi:
                    ordered = place[ia] < place[ib]
                    ia, ib = ia[ordered], ib[ordered]
                pair = place[ia] % size * size + place[ib] % size
                np.add.at(n, pair, 1)
                np.add.at(pixels, pair[first_common([m[ia] for m in masks], [m[ib] for m in masks], word[ia], bit[ia])], 1)
                x, y = value[ia], value[ib]
                differ = (x != y) & (known is None or known[ia] & known[ib])
                if value.dtype.kind == "f":
                    differ &= ~(np.isnan(x) & np.isnan(y))
                ia, ib, pair = ia[differ], ib[differ], pair[differ]
                np.add.at(off, pair, 1)
                won = at[ia] < best[pair]
                ia, ib, pair = ia[won], ib[won], pair[won]
                best[pair], first[pair], second[pair] = at[ia], v[ia], v[ib]
        if key is not None:
            yield from made()

    return run


def _pieces(size: int):
    """A task over rows (block, place, src, at, v, value) sorted by block, at and place: packs of PIECE samples of a block, whole pixels each."""

    def stream(table: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_table(table.combine_chunks())
        return sink.getvalue().to_pybytes()

    def packed(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        at, slot = rows.column("at"), pa.array(rows.column("place").to_numpy() % size, pa.int32())
        slots, first = np.unique(slot.to_numpy(), return_index=True)
        sources = pa.table({"slot": pa.array(slots, pa.int32()), "src": rows.column("src").take(pa.array(first))})
        samples = rows.drop_columns(["block", "place", "src"]).append_column("slot", slot)
        columns = [[block], [at[0].as_py()], [at[-1].as_py()], [stream(sources)], [stream(samples)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()] * 2, strict=True)], ["block", "start", "stop", "sources", "samples"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n, last = None, [], 0, None
        for batch in batches:
            blocks, pixels = batch.column("block").to_numpy(), batch.column("at").to_numpy() >> 8
            cut = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(batch)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                while i < j:
                    end = j
                    if blocks[i] == block and n >= PIECE:
                        # a pixel's samples stay together: the piece ends where the next pixel begins
                        end = i + int(np.argmax(pixels[i:j] != last)) if pixels[j - 1] != last else j
                    elif blocks[i] == block:
                        end = min(j, i + PIECE - n)
                    if held and (blocks[i] != block or end == i):
                        yield packed(block, held)
                        held, n, end = [], 0, min(j, i + PIECE)
                    block, last = int(blocks[i]), pixels[end - 1]
                    held.append(batch.slice(i, end - i))
                    n, i = n + end - i, end
        if held:
            yield packed(block, held)

    return run


class _Piece:
    """A piece as arrays in order of place; `order` sorts them by source, then place."""

    def __init__(self, block: int, sources: bytes, samples: bytes, size: int):
        names, rows = (pa.ipc.open_stream(part).read_all() for part in (sources, samples))
        self.block, self.v, self.srcs = block, rows.column("v").combine_chunks(), names.column("src").combine_chunks()
        self.named = np.zeros(size, np.int64)
        self.named[names.column("slot").to_numpy()] = np.arange(len(names))
        self.slot, self.at = rows.column("slot").to_numpy().astype(np.min_scalar_type(size)), rows.column("at").to_numpy()
        self.value, self.known = _known(rows.column("value" if "value" in rows.column_names else "v").combine_chunks())
        new = np.diff(self.at, prepend=self.at[0] - 1) != 0
        self.cell, first = np.cumsum(new) - 1, np.flatnonzero(new)
        self.cells, self.start, self.many = self.at[first], first, np.diff(first, append=len(new))
        self.order = np.argsort(self.slot, kind="stable")
        # the bands that a source has at a pixel as bits, 63 to a word
        slot, pixel, band = self.slot[self.order], self.at[self.order] >> 8, self.at & 255
        begins = np.flatnonzero((np.diff(pixel, prepend=pixel[0] - 1) != 0) | (np.diff(slot.astype(np.int64), prepend=-1) != 0))
        width = np.diff(begins, append=len(slot))
        self.word, self.bit, self.several = band // 63, np.int64(1) << (band % 63), np.zeros(len(slot), bool)
        self.several[self.order] = np.repeat(width > 1, width)
        self.masks = []
        for k in range(int(self.word.max()) + 1 if self.several.any() else 0):
            whole = np.bitwise_or.reduceat(np.where(self.word == k, self.bit, 0)[self.order], begins)
            self.masks.append(np.empty(len(slot), np.int64))
            self.masks[-1][self.order] = np.repeat(whole, width)


def _again(a: _Piece, b: _Piece, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Whether a band before this one is at the pixel in both sources too."""
    out, none, word, bit = np.ones(len(ia), bool), np.ones(len(ia), bool), a.word[ia], a.bit[ia]
    for k, (x, y) in enumerate(zip(a.masks, b.masks)):  # noqa: B905
        both = x[ia] & y[ib]
        out &= ~(none & (word == k) & (bit == (both & -both)))
        none &= both == 0
    return out


def _shared(a: _Piece, b: _Piece, size: int, at_once: int) -> Iterator[tuple]:
    """Once for each source of a and one of b that share samples: both, pixels, samples, differing ones, and the first of those in a and in b (-1: none).

    The sources of a are passed one after another, at_once pairs of samples at a time, so that the counts in hand are those of a few sources.
    """
    spot = np.minimum(np.searchsorted(b.cells, a.cells), len(b.cells) - 1)
    many = np.where(b.cells[spot] == a.cells, b.many[spot], 0)[a.cell[a.order]]
    mine = a.order[many > 0]
    many, start, slot = many[many > 0], b.start[spot][a.cell[mine]], a.slot[mine].astype(np.int64)
    sums, ends = np.cumsum(many), np.flatnonzero(np.diff(slot, append=-1)) + 1
    value, several = a.value[mine], a.several[mine]
    both = several.any() and b.several.any()
    i, carried = 0, None
    while i < len(mine):
        done = sums[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(sums, done + at_once, "right")))
        end = np.searchsorted(ends, j, "right") - 1
        whole = end >= 0 and ends[end] > i
        j = int(ends[end]) if whole else j
        base, m = slot[i], many[i:j]
        room = int(slot[j - 1] - base + 1) * size
        ia = np.repeat(mine[i:j], m)
        ib = np.repeat(start[i:j] - (sums[i:j] - m - done), m) + np.arange(len(ia))
        x, other, twice = np.repeat(value[i:j], m), b.slot.take(ib), np.repeat(several[i:j], m) if both else None
        pair = np.repeat((slot[i:j] - base) * size, m) + other
        if a.block == b.block:
            ordered = np.repeat(slot[i:j], m) < other
            ia, ib, pair, x, twice = (k[ordered] if k is not None else None for k in (ia, ib, pair, x, twice))
        n = np.bincount(pair, minlength=room)
        pixels = n.copy()
        if both:
            twice = np.flatnonzero(twice & b.several.take(ib))
            pixels -= np.bincount(pair[twice[_again(a, b, ia[twice], ib[twice])]], minlength=room)
        y = b.value.take(ib)
        differ = x != y
        for known, at in ((a.known, ia), (b.known, ib)):
            if known is not None:
                differ &= known[at]
        if x.dtype.kind == "f":
            differ &= (x == x) | (y == y)
        found = np.flatnonzero(differ)
        off = np.bincount(pair[found], minlength=room) if 2 * len(found) < len(differ) else n - np.bincount(pair[~differ], minlength=room)
        # from the last place to the first: of several values for a pair that of the first place is set last
        first = np.full(room, -1)
        first[pair[found[::-1]]] = found[::-1]
        ia, ib = (np.append(k, -1)[first] for k in (ia, ib))
        if carried is not None:
            for now, before in zip((n, pixels, off), carried[:3], strict=True):
                now[:size] += before
            for now, before in zip((ia, ib), carried[3:], strict=True):
                now[:size] = np.where(before < 0, now[:size], before)
            carried = None
        if whole:
            found = np.flatnonzero(n)
            yield base + found // size, found % size, pixels[found], n[found], off[found], ia[found], ib[found]
        else:
            carried = n, pixels, off, ia, ib
        i = j


def _met(size: int, kinds: StructType):
    """A task over rows of two pieces each: of each two of their sources what they share there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, names = [f.type for f in to_arrow_schema(kinds)], kinds.names
        left = key = None
        for batch in batches:
            for k in range(len(batch)):
                # many rows have the left piece of the row before
                one, other = ([batch.column(f"{side}_{c}")[k].as_py() for c in ("block", "sources", "samples")] for side in "ab")
                if one != key:
                    left, key = _Piece(*one, size), one
                a, b = sorted((left, left if other == one else _Piece(*other, size)), key=lambda piece: piece.block)
                for first, second, pixels, n, off, ia, ib in _shared(a, b, size, AT_ONCE):
                    none = ia < 0
                    ia, ib = pa.array(ia, mask=none), pa.array(ib, mask=none)
                    columns = [a.srcs.take(pa.array(a.named[first])), b.srcs.take(pa.array(b.named[second])), pa.array(pixels), pa.array(n), pa.array(off), pa.array(a.at).take(ia), a.v.take(ia), b.v.take(ib)]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names)

    return run


def _crossed(samples: DataFrame, size: int, blocks: int, kinds: StructType) -> DataFrame:
    """Pairs of many blocks of sources: each sample is kept once, in a packed piece of its block, and each two pieces that share places are read together."""
    spark, keys = samples.sparkSession, ["block", "at", "place"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2000, blocks))
    dealt = samples.withColumn("block", F.floor(F.col("place") / size)).repartition(parts, "block").sortWithinPartitions(*keys)
    # a page is looked at after each row, as a few rows are already a group's bytes
    small = {"parquet.page.size.row.check.min": 1, "parquet.block.size": 32 << 20}
    pieces = written(dealt.mapInArrow(_pieces(size), "block long, start long, stop long, sources binary, samples binary"), **small)
    a, b = (pieces.select(*[F.col(c).alias(f"{side}_{c}") for c in pieces.columns]) for side in "ab")
    one, two = F.col("a_block"), F.col("b_block")
    # two blocks meet once, and which of them comes first alternates, so that all tasks have as much to do
    once = (one != two) & (((one + two) % 2 == 0) == (one < two)) & (F.col("a_start") <= F.col("b_stop")) & (F.col("b_start") <= F.col("a_stop"))
    met = a.join(b.hint("shuffle_replicate_nl"), once | ((one == two) & (F.col("a_start") == F.col("b_start"))))
    pairs = met.drop("a_start", "a_stop", "b_start", "b_stop").mapInArrow(_met(size, kinds), kinds)
    return pairs if pieces.groupBy("block").count().where("count > 1").isEmpty() else _summed(pairs)


def _summed(pairs: DataFrame) -> DataFrame:
    """Pairs that were counted in parts."""
    return pairs.groupBy("a_src", "b_src").agg(*[F.sum(c).alias(c) for c in ("pixels", "n", "off")], F.min_by("a_v", "at").alias("a_v"), F.min_by("b_v", "at").alias("b_v"), F.min("at").alias("at"))


def overlap_conflicts(cells: DataFrame, exact_bits: bool = False) -> DataFrame:
    """For each pair of sources that share cells: pixels, valid band samples, differing ones and the first of those.

    Sources are numbered in their order and cut into blocks. With up to COPIES blocks each sample goes once to each of them, and pairs of samples
    are made and counted in the task in which two blocks meet, tile by tile. With more, such copies would grow as the square of the sources: samples are
    kept once, packed by block, and tasks read two packs at a time. Either way what is written grows with the samples and not with the pairs,
    but for pairs counted in parts (more than ZONE or PIECE samples of a block), which are added up by a shuffle. With exact_bits
    samples differ as stored (column bits), else by value. Rows are below 2**29, columns below 2**26, bands
    below 256.
    """
    spark, value = cells.sparkSession, "bits" if exact_bits else "v"
    picked = [F.max_by("v", "ord").alias("v"), F.max_by(value, "ord").alias("value")]
    one = written(cells.where("valid").groupBy(*CELL, "src").agg(*picked).where("src is not null and band is not null and x is not null and y is not null"))
    places = running(one.select("src").distinct(), ["src"])
    sources, samples = places.count(), one.count()
    size = max(1, min(BLOCK, -(-sources // COPIES)))
    blocks = max(1, -(-sources // size))
    # a place in reading order as one number
    at = (F.col("y") * (1 << 34) + F.col("x") * 256 + F.col("band")).cast("long")
    src, v = one.schema["src"].dataType, one.schema["v"].dataType
    kinds = StructType([StructField(n, t) for n, t in zip(("a_src", "b_src", "pixels", "n", "off", "at", "a_v", "b_v"), (src, src, *[LongType()] * 4, v, v), strict=True)])
    if blocks > COPIES:
        size = max(1, min(BLOCK, PIECE // 2 * sources // samples))
        numbered = one.join(places, "src").select("place", "src", at.alias("at"), "v", *(["value"] if exact_bits else []))
        pairs = _crossed(numbered, size, -(-sources // size), kinds)
    else:
        zones = max(1, -(-2 * samples // (blocks * ZONE)))
        tile = (F.floor(F.col("y") / 16) * (1 << 22) + F.floor(F.col("x") / 16)).cast("long")
        mine = F.floor(F.col("place") / size)
        dealt = one.join(places, "src").select("place", "src", at.alias("at"), "v", "value", tile.alias("tile"), mine.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other"))
        keys = ["lo", "hi", "zone"]
        dealt = dealt.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.pmod(F.xxhash64("tile"), F.lit(zones)).alias("zone"), "tile", "place", "src", "at", "v", "value")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2000, blocks * (blocks + 1) // 2 * zones))
        pairs = dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "tile").mapInArrow(_meetings(size, kinds), kinds)
        pairs = pairs if zones == 1 else _summed(pairs)
    at = F.col("at")
    place = [F.shiftright(at, 34).alias("y"), F.shiftright(at.bitwiseAND((1 << 34) - 1), 8).alias("x"), at.bitwiseAND(255).cast("int").alias("band")]
    example = F.struct(*place, F.col("a_v").alias("first_value"), F.col("b_v").alias("second_value"))
    return pairs.select(
        F.col("a_src").alias("first_src"), F.col("b_src").alias("second_src"), "pixels", F.col("n").alias("valid_band_samples"), F.col("off").alias("conflicting_band_samples"), F.when(at.isNotNull(), example).alias("example")
    )


def verify(expected: DataFrame, actual: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per band: samples expected, found, missing, unexpected and different; all of the last three are 0 if right.

    A full outer join on the cell, so nothing that either side alone has goes unnoticed.
    """
    e = expected.select(*CELL, F.col("v").alias("e"), F.lit(True).alias("in_e"))
    a = actual.select(*CELL, F.col("v").alias("a"), F.lit(True).alias("in_a"))
    both = e.join(a, CELL, "full_outer")
    has_e, has_a = F.coalesce("in_e", F.lit(False)), F.coalesce("in_a", F.lit(False))
    off = has_e & has_a & ~(F.col("e").eqNullSafe(F.col("a")) | (F.abs(F.col("e") - F.col("a")) <= tolerance))
    return both.groupBy("band").agg(
        F.count_if(has_e).alias("expected"), F.count_if(has_a).alias("found"), F.count_if(has_e & ~has_a).alias("missing"), F.count_if(~has_e & has_a).alias("unexpected"), F.count_if(off).alias("different")
    )


def first_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The first cell in reading order where the two differ, or no row."""
    e, a = (d.select(*CELL, F.struct("v").alias(n)) for d, n in ((expected, "e"), (actual, "a")))
    off = e.join(a, CELL, "full_outer").where(~F.col("e").eqNullSafe(F.col("a")))
    return off.agg(F.min(F.struct("band", "y", "x", "e", "a")).alias("s")).where("s is not null").select("s.band", "s.y", "s.x", F.col("s.e.v").alias("expected"), F.col("s.a.v").alias("actual"))


def compatible(metadata: DataFrame, fields: list[str]) -> DataFrame:
    """Sources whose fields aren't those of the first source; NaN equals NaN, null equals null."""
    first = metadata.orderBy("ord").limit(1).select(*[F.col(f).alias(f"__{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    return metadata.join(F.broadcast(first), ~same).select(*metadata.columns)
