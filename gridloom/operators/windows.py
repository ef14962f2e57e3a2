"""Windows of rasters in the rasters' own type, as parts of tiles of a common grid: mosaics, conflicts, verification.

A part is a row (ord, band, ty, tx, y, x, h, w, samples, valid): what one source has of one tile, samples in the type of the
rasters in reading order, valid a bit each (null: all are). Every kernel streams parts sorted by place and source, so memory holds a tile or two
whatever the number of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE = ["band", "ty", "tx"]
PART = "ord long, band int, ty long, tx long, y int, x int, h int, w int, samples binary, valid binary"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
#: Bytes of samples in a batch of rows.
BATCH_BYTES = 4 << 20


def _batches(rows: Iterator[tuple], names: list[str], types: list, size=lambda row: len(row[-2])) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _rows(batches: Iterator[pa.RecordBatch], dtype: str, plain: list[str]) -> Iterator[tuple]:
    """The plain columns of each row, then its samples and their validity (None: all) as arrays of h by w, which aren't copied."""
    kind = np.dtype(dtype)
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in plain]
        heights, widths = batch.column("h").to_numpy(), batch.column("w").to_numpy()
        samples, valid = batch.column("samples"), batch.column("valid")
        for i, (h, w) in enumerate(zip(heights.tolist(), widths.tolist(), strict=True)):
            x = np.frombuffer(samples[i].as_buffer(), kind).reshape(h, w)
            v = np.unpackbits(np.frombuffer(valid[i].as_buffer(), np.uint8))[: h * w].reshape(h, w).view(bool) if valid[i].is_valid else None
            yield (*(c[i] for c in columns), x, v)


def parts(windows: DataFrame, edge: int, dtype: str) -> DataFrame:
    """Windows of files (ord, band, x, y, w, h, samples, valid; x and y on the common grid) cut at the tiles of that grid."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for ord_, band, x, y, samples, valid in _rows(batches, dtype, ["ord", "band", "x", "y"]):
                h, w = samples.shape
                for ty in range(y // edge, (y + h - 1) // edge + 1):
                    for tx in range(x // edge, (x + w - 1) // edge + 1):
                        a, b, c, d = max(x, tx * edge), min(x + w, (tx + 1) * edge), max(y, ty * edge), min(y + h, (ty + 1) * edge)
                        here = slice(c - y, d - y), slice(a - x, b - x)
                        good = None if valid is None else valid[here]
                        if good is not None and not good.any():
                            continue
                        packed = None if good is None or good.all() else np.packbits(good).tobytes()
                        yield ord_, band, ty, tx, c - ty * edge, a - tx * edge, d - c, b - a, samples[here].tobytes(), packed

        yield from _batches(made(), [c.split()[0] for c in PART.split(", ")], _TYPES)

    return windows.select("ord", "band", "x", "y", "w", "h", "samples", "valid").mapInArrow(cut, PART)


def composed(sorted_parts: DataFrame, edge: int, dtype: str, policy: str, fill: float) -> DataFrame:
    """Parts sorted by place, then ord, to a mosaic: band, ty, tx, samples of the whole tile with `fill` where none is valid, and valid (null: all are)."""
    kind = np.dtype(dtype)
    value = np.array(fill).astype(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            at, out, have = None, None, None
            for band, ty, tx, y, x, samples, valid in _rows(batches, dtype, [*PLACE, "y", "x"]):
                if (band, ty, tx) != at:
                    if at is not None:
                        yield (*at, out.tobytes(), None if have.all() else np.packbits(have).tobytes())
                    at, out, have = (band, ty, tx), np.full((edge, edge), value, kind), np.zeros((edge, edge), bool)
                h, w = samples.shape
                target, known = out[y : y + h, x : x + w], have[y : y + h, x : x + w]
                take = (~known if valid is None else valid & ~known) if policy == "first" else valid
                if take is None:
                    target[:] = samples
                else:
                    np.copyto(target, samples, where=take)
                known |= True if valid is None else valid
            if at is not None:
                yield (*at, out.tobytes(), None if have.all() else np.packbits(have).tobytes())

        yield from _batches(made(), [*PLACE, "samples", "valid"], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return sorted_parts.mapInArrow(run, "band int, ty long, tx long, samples binary, valid binary")


def _bits(x: np.ndarray) -> np.ndarray:
    return x.view(f"u{x.itemsize}")


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where samples are of other bits; NaN equals NaN."""
    off = _bits(x) != _bits(y)
    return off & ~(np.isnan(x) & np.isnan(y)) if x.dtype.kind == "f" else off


def conflicts(cut: DataFrame, edge: int, dtype: str) -> DataFrame:
    """(first, second, n, y, x, band): for each place's first valid sample and a later source's other value, how many differ and the first of those.

    A sample is held against the first valid one of its place. Of the least pair of sources that differ anywhere n is exact: were a sample
    of theirs owned by an earlier source, that one would differ from one of them. Tiles are compared as they are packed.
    """
    kind = np.dtype(dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            at, out, owner = None, None, None
            for band, ty, tx, y, x, ord_, samples, valid in _rows(batches, dtype, [*PLACE, "y", "x", "ord"]):
                if (band, ty, tx) != at:
                    at, out, owner = (band, ty, tx), np.zeros((edge, edge), kind), np.full((edge, edge), -1, np.int64)
                h, w = samples.shape
                target, known = out[y : y + h, x : x + w], owner[y : y + h, x : x + w]
                off = (known >= 0) & (known != ord_) & _differ(target, samples)
                if valid is not None:
                    off &= valid
                rows, columns = np.nonzero(off)
                for one in np.unique(known[rows, columns]).tolist() if len(rows) else ():
                    some = np.flatnonzero(known[rows, columns] == one)
                    yield one, ord_, len(some), ty * edge + y + int(rows[some[0]]), tx * edge + x + int(columns[some[0]]), band
                take = known < 0 if valid is None else (known < 0) & valid
                np.copyto(target, samples, where=take)
                known[take] = ord_

        yield from _batches(made(), ["first", "second", "n", "y", "x", "band"], [pa.int64()] * 5 + [pa.int32()], lambda row: 64)

    dealt = cut.repartition(*PLACE).sortWithinPartitions(*PLACE, "ord")
    found = dealt.mapInArrow(run, "first long, second long, n long, y long, x long, band int")
    return found.groupBy("first", "second").agg(F.sum("n").alias("n"), F.min(F.struct("y", "x", "band")).alias("at")).select("first", "second", "n", "at.*")


def verify(expected: DataFrame, actual: DataFrame, edge: int, dtype: str, policy: str = "first") -> DataFrame:
    """Per band: samples expected, found, missing, unexpected and different; the last three are 0 if right.

    expected: parts, of which the first or last source in the order of ord counts; actual: parts of the mosaic. Both meet in one shuffle and are
    compared bit by bit, NaN being equal to NaN.
    """
    names = ["expected", "found", "missing", "unexpected", "different"]
    kind = np.dtype(dtype)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        at, tile, have = None, None, None

        def close():
            both = have[0] & have[1]
            facts = [have[0].sum(), have[1].sum(), (have[0] & ~have[1]).sum(), (have[1] & ~have[0]).sum(), (both & _differ(tile[0], tile[1])).sum()]
            total[at[0]] = total.get(at[0], np.zeros(5, np.int64)) + np.array(facts, np.int64)

        for band, ty, tx, y, x, role, samples, valid in _rows(batches, dtype, [*PLACE, "y", "x", "role"]):
            if (band, ty, tx) != at:
                if at is not None:
                    close()
                at, tile, have = (band, ty, tx), np.zeros((2, edge, edge), kind), np.zeros((2, edge, edge), bool)
            h, w = samples.shape
            target, known = tile[role, y : y + h, x : x + w], have[role, y : y + h, x : x + w]
            take = (~known if valid is None else valid & ~known) if policy == "first" else np.ones(known.shape, bool) if valid is None else valid
            np.copyto(target, samples, where=take)
            known |= take
        if at is not None:
            close()
        columns = zip(*[(band, *facts.tolist()) for band, facts in total.items()], strict=True) if total else ((),) * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(columns)], ["band", *names])

    both = expected.withColumn("role", F.lit(0)).unionByName(actual.withColumn("role", F.lit(1)))
    dealt = both.repartition(*PLACE).sortWithinPartitions(*PLACE, "role", "ord")
    return dealt.mapInArrow(count, "band int, " + ", ".join(f"{n} long" for n in names)).groupBy("band").agg(*[F.sum(n).alias(n) for n in names])


STORED = "ord long, band int, y long, x long, h int, w int, samples binary, valid binary"


def halved(windows: DataFrame, edge: int, dtype: str, method: str) -> DataFrame:
    """The next level of rasters: windows (ord: which raster) to tiles of edge by edge of half the size, in STORED form.

    Each stored tile comes from a square of twice the edge, whose parts meet in one shuffle; so a level is made by as many tasks as there are
    squares. average: the mean of the valid ones of each four, rounded for integers; nearest: the first of each four, valid or not.
    """
    kind = np.dtype(dtype)

    def half(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if method == "nearest":
            return x[::2, ::2], good[::2, ::2]
        fours, count = np.zeros((len(x) // 2, x.shape[1] // 2)), np.zeros((len(x) // 2, x.shape[1] // 2), np.uint8)
        for a in (0, 1):
            for b in (0, 1):
                v = good[a::2, b::2]
                fours += np.where(v, x[a::2, b::2], 0)
                count += v
        mean = fours / np.maximum(count, 1)
        return (np.rint(mean) if kind.kind != "f" else mean).astype(kind), count > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            at, tile, have, high, wide = None, None, None, 0, 0

            def close():
                x, good = half(tile, have)
                h, w = -(-high // 2), -(-wide // 2)
                good = np.ascontiguousarray(good[:h, :w])
                return at[0], at[1], at[2] * edge, at[3] * edge, h, w, np.ascontiguousarray(x[:h, :w]).tobytes(), None if good.all() else np.packbits(good).tobytes()

            for ord_, band, ty, tx, y, x, samples, valid in _rows(batches, dtype, ["ord", *PLACE, "y", "x"]):
                if (ord_, band, ty, tx) != at:
                    if at is not None:
                        yield close()
                    at, tile, have, high, wide = (ord_, band, ty, tx), np.zeros((2 * edge, 2 * edge), kind), np.zeros((2 * edge, 2 * edge), bool), 0, 0
                h, w = samples.shape
                tile[y : y + h, x : x + w] = samples
                have[y : y + h, x : x + w] = True if valid is None else valid
                high, wide = max(high, y + h), max(wide, x + w)
            if at is not None:
                yield close()

        yield from _batches(made(), [c.split()[0] for c in STORED.split(", ")], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    cut = parts(windows, 2 * edge, dtype)
    return cut.repartition("ord", *PLACE).sortWithinPartitions("ord", *PLACE).mapInArrow(run, STORED)
