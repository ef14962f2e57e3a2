"""Near-duplicate groups by SimHash fingerprints, compared exactly in tiles."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_batches, components, local_roots, mix64, passes, shared_dir, utf8
from gridloom.llm.suffix import _grouped

#: Rows of a tile; also the size beyond which a group is split into tiles that separate tasks compare.
TILE = 1024
_UNIT = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of each document's hashes set each of 64 bits: eight bits at a time, in bytes that hold up to 255."""
    most = 255
    parts = -(-sizes // most)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    cut = np.repeat(starts, parts) + step * most
    first = np.cumsum(parts) - parts
    out = np.zeros((len(sizes), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _UNIT, cut)
        out[:, k::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first)
    return out


def shingle_hashes(text: bytes, words: int) -> tuple[bytes, int]:
    """XXH64 (seed 42) of every shingle of `words` words, big endian in a row, and their number."""
    found = text.lower().split()
    if not found:
        return b"", 0
    digest = xxhash.xxh64_digest
    if len(found) <= words:
        return digest(b" ".join(found), 42), 1
    line = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    stop = np.cumsum(sizes + 1) - 1
    start = stop - sizes
    return b"".join([digest(line[a:b], 42) for a, b in zip(start[: len(found) - words + 1].tolist(), stop[words - 1 :].tolist(), strict=True)]), len(found) - words + 1


def fingerprints(found: list[np.ndarray], lanes: int = 1, mins: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Per text, whose shingles' hashes are given, `lanes` times 64 bits that are set in over half of them, and `mins` least hashes.

    No shingles: zero bits. Further lanes and the least hashes come from scrambled copies of the same hashes.
    """
    sizes = np.array([len(x) for x in found], np.int64)
    hashes = np.concatenate([np.zeros(0, np.uint64), *found])
    bits, least = np.zeros((len(found), lanes), np.uint64), np.zeros((len(found), mins), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        size = sizes[some]
        starts = np.cumsum(size) - size
        for k in range(lanes):
            lane = mix64(hashes + np.uint64(k * 0x51ED270B)) if k else hashes
            set_ = 2 * _bit_counts(lane, starts, size) > size[:, None]
            bits[some, k] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64)[:, 0]
        for k in range(mins):
            least[some, k] = np.minimum.reduceat(mix64(hashes ^ np.uint64((k + 1) * 0x2545F4914F6CDD1D)), starts)
    return bits, least


def _fingerprint(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(1))
            for i, j in passes(ends):
                hashes = [np.frombuffer(shingle_hashes(data[a:b].tobytes(), words)[0], ">u8").astype(np.uint64) for a, b in zip(ends[i:j], ends[i + 1 : j + 1], strict=True)]
                bits, _ = fingerprints(hashes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(bits[:, 0].view(np.int64))], ["doc_id", "node"])

    return run


def _tile_links(bits: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one group, a tile of rows at a time: exclusive-or, count, and a forest of what is near enough.

    Rows are sorted by population count, so tiles whose counts differ beyond the radius are never paired.
    side: rows of the same tile pair have 0 or 1; where both are there, only pairs across them count.
    """
    counts = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    by = np.argsort(counts, kind="stable")
    bits, counts, side = bits[by], counts[by], side[by]
    across = side.min() != side.max()
    a, b, n, lanes = [], [], len(bits), bits.shape[1]
    for i in range(0, n, TILE):
        mine = slice(i, min(i + TILE, n))
        for j in range(i, n, TILE):
            other = slice(j, min(j + TILE, n))
            if counts[other.start] - counts[mine.stop - 1] > radius:
                break
            far = np.zeros((mine.stop - mine.start, other.stop - other.start), np.uint16)
            for k in range(lanes):
                far += np.bitwise_count(bits[mine, k, None] ^ bits[None, other, k])
            near = far <= radius
            if across:
                near &= side[mine, None] != side[None, other]
            x, y = np.nonzero(np.triu(near, 1) if i == j else near)
            if len(x):
                x, y = x + i, y + j
                # a forest says as much as all pairs, of which a group of copies has its square
                seen, back = np.unique(np.concatenate([x, y]), return_inverse=True)
                root = local_roots(back[: len(x)], back[len(x) :], len(seen))
                keep = root != np.arange(len(seen))
                a.append(seen[keep]), b.append(seen[root[keep]])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return by[np.concatenate(a)], by[np.concatenate(b)]


def _small_links(bits: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many small groups at once: each row against the next, the one after it, and so on in its group."""
    a, b, d, at = [], [], 1, np.arange(len(group))
    while True:
        at = at[at + d < len(group)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        near = np.bitwise_count(bits[at] ^ bits[at + d]).sum(axis=1) <= radius
        a.append(at[near]), b.append(at[near] + d)
        d += 1
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _links(lanes: int, radius: int, small: int = 48):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held):
            t = pa.Table.from_batches(held)
            bits = np.stack([t.column(f"b{k}").to_numpy().view(np.uint64) for k in range(lanes)], axis=1)
            return t.column("tile").to_numpy(), t.column("node").to_numpy(), t.column("side").to_numpy(), bits

        def out(node, a, b):
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

        held, size = [], 0

        def flush():
            group, node, _, bits = rows(held)
            return out(node, *_small_links(bits, group, radius))

        for _, group in _grouped(batches):
            n = sum(len(x) for x in group)
            if n > small:
                _, node, side, bits = rows(group)
                yield out(node, *_tile_links(bits, side, radius))
            elif n > 1:
                held += group
                size += n
                if size > 20_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def tiles(points: DataFrame, lanes: int, radius: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Deals points out to comparisons: tile, node, side, bits and columns `more`, sorted by tile in the partitions of tiles.

    points: node long, count int (population), key long, b0.. long. A key is one tile; one that has more than
    a few tiles' rows is split by population count and hash, and pairs of tiles whose counts differ by no more
    than the radius become comparisons of their own.
    """
    bits = [*[f"b{k}" for k in range(lanes)], *more]
    spread = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20))
    sized = points.groupBy("key", "count").agg(F.count("*").alias("n"))
    total = sized.groupBy("key").agg(F.sum("n").alias("total"))
    hot = total.where(F.col("total") > 4 * TILE)
    split = sized.join(hot, "key").select("key", "count", F.ceil(F.col("n") / (2 * TILE)).cast("int").alias("tiles"))
    spread_out = points.join(split, ["key", "count"]).withColumn("t", F.pmod(spread, F.col("tiles")))
    # a key of one row has nothing to compare
    several = total.where(F.col("total").between(2, 4 * TILE)).select("key")
    cold = points.join(several, "key").select(F.xxhash64("key").alias("tile"), "node", F.lit(0).alias("side"), *bits)
    one = split.select("key", F.col("count"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"))
    two = one.select("key", F.col("count").alias("count2"), F.col("t").alias("t2"))
    pairs = one.join(two, "key").where(f"(count < count2 or count = count2 and t <= t2) and count2 - count <= {radius}")
    pairs = pairs.withColumn("tile", F.xxhash64("key", "count", "t", "count2", "t2"))
    first = pairs.select("key", "count", "t", "tile", F.lit(0).alias("side"))
    second = pairs.where("count <> count2 or t <> t2").select("key", F.col("count2").alias("count"), F.col("t2").alias("t"), "tile", F.lit(1).alias("side"))
    dealt = spread_out.join(first.union(second), ["key", "count", "t"]).select("tile", "node", "side", *bits)
    return cold.union(dealt).repartition("tile").sortWithinPartitions("tile")


def link(points: DataFrame, lanes: int, radius: int) -> DataFrame:
    """Edges (a, b) that connect all nodes within `radius` differing bits of each other and share a key.

    A comparison gives a forest of its links, never all pairs.
    """
    return tiles(points, lanes, radius).mapInArrow(_links(lanes, radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over near fingerprints.

    Fingerprints are of `words`-word shingles with A-Z in lower case, repeats included; fewer words are one
    shingle, none is fingerprint zero, which is linked like any other. Fingerprints that differ in `radius`
    or fewer bits link; equal ones are one node, so copies are never expanded. Two that differ in r bits
    agree in two of r + 2 blocks of the 64 bits, so each two blocks are a key (of 25 bits and more at radius 3) whose rows are
    compared in tiles; no pair is lost. Null and empty texts have no words. A null doc_id comes back as null, with the
    component of its fingerprint. Repeated rows come back as often. Other columns are not read.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared_dir(spark)
    prints = docs.select("doc_id", "text").mapInArrow(_fingerprint(words), "doc_id long, node long").checkpoint()
    owners = prints.groupBy("node").agg(F.min("doc_id").alias("owner"))
    edge = [64 * k // (radius + 2) for k in range(radius + 3)]
    block = [F.shiftrightunsigned("node", a).bitwiseAND((1 << b - a) - 1) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    pairs = list(itertools.combinations(range(radius + 2), 2))
    keys = [(F.shiftleft(block[a], edge[b + 1] - edge[b]) + block[b]) * len(pairs) + k for k, (a, b) in enumerate(pairs)]
    points = owners.select("node", F.bit_count("node").alias("count"), F.col("node").alias("b0"), F.explode(F.array(*keys)).alias("key"))
    roots = components(link(points, 1, radius))
    named = roots.join(owners, "node").select("component", "node", "owner")
    least = named.groupBy("component").agg(F.min("owner").alias("component_id"))
    linked = named.join(least, "component").select("node", "component_id")
    alone = owners.join(roots, "node", "left_anti").select("node", F.col("owner").alias("component_id"))
    return prints.join(linked.union(alone), "node").select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")
