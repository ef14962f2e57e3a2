"""Near duplicates by the Jaccard similarity of their word shingles: SimHash tiles first, then what they can't have seen.

Texts are shuffled once, into a table in buckets of the shared folder; whatever later asks for texts joins that
table bucket by bucket. Texts of the same words are one node. Two passes find the links between nodes:

1. Nodes that share one of a few least shingle hashes meet in tiles, where 256-bit SimHash fingerprints are
   compared by exclusive-or and bit counts, in the order of their population counts. Each tile gives a forest of
   its nearest pairs, and a pair counts once its shingle sets are as similar as asked. That joins nearly all.
2. What may still be similar and lies in different components meets in prefixes: of two sets of Jaccard s, ordered
   alike, the first floor((1 - s) n) + 1 members have one in common. Sizes, places in the order and parities rule out
   only what can't be similar; the sets decide. So no pair is lost, whatever the first pass missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_batches, bucketed, components, local_roots, mix64, partitions, passes, quoted, utf8, written
from gridloom.llm.simhash import fingerprints
from gridloom.llm.suffix import _grouped, _Strings

#: Rows of a tile. A meeting of more is split.
TILE = 512
#: Shingles of all sets of a tile together, beyond which a meeting is split too.
TILE_SHINGLES = 4 << 20
#: Nearest rows that a row of a large tile is linked to at most; the second pass has no such bound.
NEAREST = 8
#: Rows of a tile that are compared with others at once.
_ROWS = 256
#: Counters of shingles, in slices that tasks add up: how common a shingle is, which orders those of a text.
COUNTERS, SLICE = 1 << 20, 1 << 16
#: Bits of parity for each shingle of a set, rounded up to a power of two.
PARITY = 2
#: Sizes of sets travel as powers of this, and places in the order as so many steps of a prefix.
_STEP, _PLACES = 1.002, 250
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint8)
#: Bytes that packed sets of one comparison, and pairs of them that are looked at together, may take.
PACKED_BYTES, PAIR_BYTES = 64 << 20, 8 << 20


def shingles(data: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of all texts' shingles in order, where each text's begin, and a hash of each text's words.

    Words are runs of other than white space (0x20, 0x09 to 0x0D), A-Z in lower case; a shingle's hash is a sum over
    those of its words, a text of fewer words is one shingle, one of none has none.
    """
    n, count = len(data), len(ends) - 1
    inside, fresh = ~_SPACE[data], np.zeros(n + 1, bool)
    fresh[ends] = True
    first, final = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:n]
    final[:-1] &= ~inside[1:] | fresh[1:n]
    start, stop = np.flatnonzero(first), np.flatnonzero(final) + 1
    word = _Strings(_LOWER[data]).of(start, stop) if n else np.zeros(0, np.uint64)
    held = np.bincount(np.searchsorted(ends, start, "right") - 1, minlength=count)
    at = np.cumsum(held) - held
    made = np.where(held > 0, np.maximum(held - words + 1, 1), 0)
    cut = np.concatenate([[0], np.cumsum(made)])
    place = np.repeat(at - cut[:-1], made) + np.arange(cut[-1])
    size = np.repeat(np.minimum(held, words), made)
    total, factor = size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25), 1
    for k in range(words):
        total += np.where(k < size, word[np.minimum(place + k, len(word) - 1)] * np.uint64(factor), np.uint64(0)) if len(word) else total
        factor = factor * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    return mix64(total), cut, [xxhash.xxh3_128_digest(word[a : a + n].tobytes()) for a, n in zip(at.tolist(), held.tolist(), strict=True)]


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """Distinct shingles in order, as 48 bits of their hashes."""
    x = np.sort(hashes >> np.uint64(16))
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int) -> list[np.ndarray]:
    hashes, cut, _ = shingles(data, ends, words)
    return [_distinct(hashes[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _packed_set(found: np.ndarray) -> bytes:
    return found.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked_set(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def parity(found: np.ndarray) -> bytes:
    """Whether the number of a set's members with each remainder is odd: a power of two of bits, PARITY for each member or more.

    A member that only one of two sets has turns one bit, so two sets differ in as many members as bits, or more.
    Halves laid over each other are the parities of half as many remainders.
    """
    width = 64 << max(0, (PARITY * len(found) - 1).bit_length() - 6)
    odd = np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class _Parities:
    """Parities of the rows of a tile, folded to the width that is asked for."""

    def __init__(self, packed: list[bytes]):
        self.words = np.array([len(x) // 8 for x in packed], np.int64)
        self.flat, self.start = np.frombuffer(b"".join(packed), np.uint64), np.cumsum(self.words) - self.words

    def folded(self, rows: np.ndarray, words: int) -> np.ndarray:
        """The rows, each at least that wide, as `words` words."""
        out = np.zeros((len(rows), words), np.uint64)
        for wide in np.unique(self.words[rows]).tolist():
            some = np.flatnonzero(self.words[rows] == wide)
            full = self.flat[self.start[rows[some], None] + np.arange(wide)]
            out[some] = np.bitwise_xor.reduce(full.reshape(len(some), -1, words), axis=1)
        return out

    def far(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Differing bits of pairs of rows, at the lesser width of the two."""
        out, words = np.zeros(len(x), np.int64), np.minimum(self.words[x], self.words[y])
        for w in np.unique(words).tolist():
            at = np.flatnonzero(words == w)
            step = max(1, PAIR_BYTES // (8 * w))
            for i in range(0, len(at), step):
                part = at[i : i + step]
                rows, back = np.unique(np.concatenate([x[part], y[part]]), return_inverse=True)
                made = self.folded(rows, w)
                out[part] = np.bitwise_count(made[back[: len(part)]] ^ made[back[len(part) :]]).sum(axis=1, dtype=np.int64)
        return out


def _bits(table: pa.Table, lanes: int) -> np.ndarray:
    return np.stack([table.column(f"b{k}").to_numpy().view(np.uint64) for k in range(lanes)], axis=1)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    far = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        far += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return far


def _sketched(words: int, lanes: int, mins: int):
    """Of each row: hash of its words, number of distinct shingles, fingerprint and least hashes of those, parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(3))
            for i, j in passes(ends):
                hashes, cut, lines = shingles(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], words)
                sets = [_distinct(hashes[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                bits, least = fingerprints([mix64(x) for x in sets], lanes, mins)
                line = np.frombuffer(b"".join(lines), np.int64).reshape(-1, 2)
                columns = [*[batch.column(k).slice(i, j - i) for k in range(3)], pa.array(line[:, 0]), pa.array(line[:, 1]), pa.array([len(x) for x in sets], pa.int32())]
                columns += [pa.array(bits[:, k].view(np.int64)) for k in range(lanes)]
                columns.append(pa.array(least.view(np.int64).tolist(), pa.list_(pa.int64())))
                columns.append(pa.array([parity(x) for x in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["rid", "r", "doc_id", "one", "two", "size", *[f"b{k}" for k in range(lanes)], "least", "odd"])

    return run


# the first pass


def _forest(x: np.ndarray, y: np.ndarray, far: np.ndarray) -> list[int]:
    """Of pairs, those of a forest of least distances."""
    root: dict[int, int] = {}

    def top(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = root.get(up, up)
            v = root[v]
        return v

    keep, a, b = [], x.tolist(), y.tolist()
    for i in np.argsort(far, kind="stable").tolist():
        p, q = top(a[i]), top(b[i])
        if p != q:
            root[p] = q
            keep.append(i)
    return keep


def _small_pairs(tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of many small tiles at once: each row with the next, the one after it, and so on in its tile."""
    x, y, d, at = [], [], 1, np.arange(len(tile))
    while len(at := at[at + d < len(tile)]) and len(at := at[tile[at] == tile[at + d]]):
        x.append(at), y.append(at + d)
        d += 1
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(x or empty), np.concatenate(y or empty)


def _large_pairs(bits: np.ndarray, radius: int) -> tuple[np.ndarray, ...]:
    """Each row of a tile with its nearest ones; runs of rows whose population counts differ beyond the radius are passed over."""
    counts = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    by = np.argsort(counts, kind="stable")
    bits, counts, found = bits[by], counts[by], []
    for i in range(0, len(bits), _ROWS):
        rows = np.arange(i, min(i + _ROWS, len(bits)))
        low, high = np.searchsorted(counts, counts[rows[0]] - radius, "left"), np.searchsorted(counts, counts[rows[-1]] + radius, "right")
        far = _differing(bits[rows], bits[low:high]).astype(np.int64)
        far[rows - i, rows - low] = radius + 1
        k = min(NEAREST, far.shape[1]) - 1
        near = np.argpartition(far, k, axis=1)[:, : k + 1]
        apart = np.take_along_axis(far, near, 1)
        r, c = np.nonzero(apart <= radius)
        found.append((by[rows[r]], by[near[r, c] + low], apart[r, c]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _nearest(lanes: int, radius: int, similarity: float, small: int = 48):
    """A forest of the nearest pairs of each tile: within the radius, of sizes that may be as similar."""

    def links(held: list[pa.RecordBatch], large: bool) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        node, size, bits = t.column("node").to_numpy(), t.column("size").to_numpy(), _bits(t, lanes)
        if large:
            x, y, far = _large_pairs(bits, radius)
        else:
            x, y = _small_pairs(t.column("tile").to_numpy())
            far = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
        good = (far <= radius) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y])) & (node[x] != node[y])
        x, y, far = x[good], y[good], far[good]
        # rows of small tiles are told apart by their place, so that each tile has a forest of its own
        keep = _forest(x, y, far)
        a, b = node[x[keep]], node[y[keep]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for _, group in _grouped(batches):
            n = sum(len(x) for x in group)
            if n > small:
                yield links(group, True)
            elif n > 1:
                held += group
                rows += n
                if rows > 20_000:
                    yield links(held, False)
                    held, rows = [], 0
        if held:
            yield links(held, False)

    return run


def _batch_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The shingle sets of a batch's texts; a text that follows itself is looked at once."""
    data, ends = utf8(column)
    size = np.diff(ends)
    new = [k == 0 or size[k] != size[k - 1] or not np.array_equal(data[ends[k] : ends[k + 1]], data[ends[k - 1] : ends[k]]) for k in range(len(size))]
    keep = np.flatnonzero(new)
    flat = data if len(keep) == len(size) else np.concatenate([np.zeros(0, np.uint8), *[data[ends[k] : ends[k + 1]] for k in keep]])
    own, sets = np.concatenate([[0], np.cumsum(size[keep])]), []
    for i, j in passes(own):
        sets += shingle_sets(flat[own[i] : own[j]], own[i : j + 1] - own[i], words)
    return [sets[k] for k in np.cumsum(new) - 1]


def _sent(words: int):
    """Shingle sets of one side of the pairs, on their way to the rows of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_packed_set(x) for x in _batch_sets(batch.column(0), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.binary())], [*batch.schema.names[1:], "set"])

    return run


def _held(words: int, similarity: float):
    """Pairs whose sets are as similar: one comes along, the other is that of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (one, packed) in enumerate(zip(_batch_sets(batch.column(0), words), batch.column(3), strict=True)):
                two = _unpacked_set(packed.as_py())
                same = len(np.intersect1d(one, two, assume_unique=True))
                good[i] = same >= similarity * (len(one) + len(two) - same)
            yield from pa.Table.from_batches([batch]).select(["a", "b"]).filter(pa.array(good)).combine_chunks().to_batches()

    return run


def _meetings(rows: DataFrame) -> DataFrame:
    """key, n of the groups of rows (key, node) with several nodes, one key for those of the same nodes."""
    marks = [F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in range(2)]]
    return rows.groupBy("key").agg(*marks).where("n > 1").groupBy("n", "x0", "x1").agg(F.min("key").alias("key")).select("key", "n")


def _first_links(texts: DataFrame, nodes: DataFrame, words: int, similarity: float, lanes: int) -> DataFrame:
    """Edges (a, b) of nearest pairs that share a least hash and whose sets are as similar.

    A hash of more nodes than a tile takes is dealt over a ring of tiles, each node in two that follow one
    another, so the rows grow with the nodes and not with their square.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    radius = int(64 * lanes * share + 3.5 * (64 * lanes * share * (1 - share)) ** 0.5)
    rows = nodes.where("size > 0").select("node", F.posexplode("least").alias("which", "hash")).select("node", F.xxhash64("which", "hash").alias("key"))
    ring = F.ceil(F.col("n") / TILE).cast("int")
    t = F.pmod(F.xxhash64("node", F.lit(3)), ring).cast("int")
    places = F.when(ring == 1, F.array(F.lit(0))).otherwise(F.array(t, F.pmod(t + 1, ring)))
    dealt = rows.join(_meetings(rows), "key").select("node", "key", F.explode(places).alias("t")).select(F.xxhash64("key", "t").alias("tile"), "node")
    points = dealt.join(nodes.select("node", "size", *[f"b{k}" for k in range(lanes)]), "node").select("tile", "node", "size", *[f"b{k}" for k in range(lanes)])
    near = points.repartition("tile").sortWithinPartitions("tile").mapInArrow(_nearest(lanes, radius, similarity), "a long, b long").distinct()
    # either side's set may be the one that travels
    turned = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0
    near = written(near.select(F.when(turned, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("b")))
    place = lambda side, r, rid: nodes.select(F.col("node").alias(side), F.col("r").alias(r), F.col("rid").alias(rid))
    asked = near.join(place("a", "r", "at"), "a").join(place("b", "to", "to_rid"), "b")
    sets = texts.join(asked.hint("shuffle_hash"), (texts["r"] == asked["r"]) & (texts["rid"] - asked["at"] == 0)).select("text", "to", "to_rid", "a", "b")
    sets = sets.mapInArrow(_sent(words), "to long, to_rid long, a long, b long, set binary")
    both = texts.join(sets.hint("shuffle_hash"), (texts["r"] == sets["to"]) & (texts["rid"] - sets["to_rid"] == 0)).select("text", "a", "b", "set")
    return both.mapInArrow(_held(words, similarity), "a long, b long")


# the second pass


def _frequencies(words: int):
    """How many texts of a partition have a shingle of each counter, a row of packed counts for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            data, ends = utf8(batch.column(0))
            for i, j in passes(ends):
                sets = shingle_sets(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], words)
                counts += np.bincount(_counter(np.concatenate(sets)), minlength=COUNTERS).astype(np.uint32)
        if counts.any():
            packed = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(-1, SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(packed)), pa.int32()), pa.array(packed, pa.binary())], ["slice", "counts"])

    return run


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(48 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The magnitude (half powers of two) of each counter of a slice over all partitions, and the slice's sum; rows are added as they stream by."""

    def made(key: int, total: np.ndarray) -> pa.RecordBatch:
        size = np.floor(2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([size.tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], ["slice", "counts", "total"])

    at, total = None, np.zeros(SLICE, np.int64)
    for batch in batches:
        for key, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if key != at:
                if at is not None:
                    yield made(at, total)
                at, total = key, np.zeros(SLICE, np.int64)
            total += np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
    if at is not None:
        yield made(at, total)


def rarity(texts: DataFrame, words: int) -> np.ndarray:
    """How common the shingles of each counter are: a megabyte, whatever the number of texts.

    Counters about as full as all are say nothing of a shingle and count alike; so what the order tells of
    common shingles is the same at every size.
    """
    parts = texts.select("text").mapInArrow(_frequencies(words), "slice int, counts binary")
    parts = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(_added, "slice int, counts binary, total long").collect()
    out = np.zeros((COUNTERS // SLICE, SLICE), np.uint8)
    for x in parts:
        out[x["slice"]] = np.frombuffer(x["counts"], np.uint8)
    usual = np.log2(max(1.0, sum(x["total"] for x in parts) / COUNTERS)) + 1
    return np.maximum(out.ravel(), np.uint8(min(254, int(2 * usual))))


def prefix(found: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, rarest first, so many that any set as similar has one of its own such shingles among them."""
    n = len(found)
    most = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
    order = common[_counter(found)].astype(np.uint64) << np.uint64(48) | found
    if most < n:
        order = np.partition(order, most - 1)[:most]
    return np.sort(order) & np.uint64((1 << 48) - 1)


#: Keys of texts' prefixes, of 15 bytes each, that meet in one shard, about.
SHARD_KEYS = 500_000
_FIELDS = (("<u4", 4), ("<i8", 8), ("<u2", 2), ("u1", 1))


def _prefixes(words: int, similarity: float, common, shards: int):
    """The prefix of each node, packed by shard of the shingles: shingle, node, size and place of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(1).to_numpy()
            data, ends = utf8(batch.column(0))
            for i, j in passes(ends, 4 << 20):
                sets = shingle_sets(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], words)
                keys = [prefix(x, common.value, similarity) for x in sets]
                many, sizes = np.array([len(x) for x in keys]), np.array([len(x) for x in sets])
                key = (np.concatenate(keys) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                place = np.arange(len(key)) - np.repeat(np.cumsum(many) - many, many)
                n = np.repeat(sizes, many)
                place = np.floor(place / np.maximum(n * (1 - similarity), 1e-9) * _PLACES).clip(0, 255).astype(np.uint8)
                level = np.floor(np.log(np.maximum(n, 1)) / np.log(_STEP)).astype(np.uint16)
                shard = key % np.uint32(shards)
                by = np.lexsort((key, shard))
                columns = [x[by] for x in (key, np.repeat(ids[i:j], many), level, place)]
                shard = shard[by]
                cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(key) else np.zeros(0, np.int64)
                stop = np.append(cut[1:], len(key))
                blobs = []
                for a, b in zip(cut, stop, strict=False):
                    planes = [x[a:b].astype(kind).view(np.uint8).reshape(-1, size).T.tobytes() for x, (kind, size) in zip(columns, _FIELDS, strict=True)]
                    blobs.append(packer.compress(b"".join(planes)))
                yield pa.RecordBatch.from_arrays([pa.array(shard[cut].astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "packed"])

    return run


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    unpacker, out = zstandard.ZstdDecompressor(), [[] for _ in _FIELDS]
    for blob in blobs:
        flat = np.frombuffer(unpacker.decompress(blob), np.uint8)
        n, at = len(flat) // sum(size for _, size in _FIELDS), 0
        for k, (kind, size) in enumerate(_FIELDS):
            out[k].append(np.ascontiguousarray(flat[at : at + n * size].reshape(size, n).T).reshape(-1).view(kind))
            at += n * size
    return [np.concatenate(x) for x in out]


def compatible(level, place, level2, place2, similarity: float) -> np.ndarray:
    """Whether sets of these sizes, whose first common member is at these places, may be as similar. Rounded so as to admit all that are."""
    low, low2 = _STEP ** level.astype(np.float64), _STEP ** level2.astype(np.float64)
    need = similarity / (1 + similarity) * (low + low2) - 1e-6
    left = low * _STEP * (1 - place / _PLACES * (1 - similarity))
    left2 = low2 * _STEP * (1 - place2 / _PLACES * (1 - similarity))
    return (np.minimum(left, left2) >= need) & (np.maximum(low, low2) * similarity <= np.minimum(low, low2) * _STEP + 1e-6)


def _met(similarity: float, looked: int = 64):
    """The nodes of each shingle that is in the prefix of several, but for those that none of these can be similar to.

    Every row of up to `looked` is held against the others; larger meetings go on as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches):
            key, node, level, place = _unpacked([x.as_py() for b in held for x in b.column(1)])
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
            by = by[np.append(False, same) | np.append(same, False)]  # most shingles have one text and drop out here
            if not len(by):
                continue
            key, node, level, place = key[by], node[by], level[by], place[by]
            first = np.append(True, key[1:] != key[:-1])
            start = np.flatnonzero(first)
            n = np.diff(np.append(start, len(key)))[np.cumsum(first) - 1]
            keep, at, d = n > looked, np.flatnonzero(n <= looked), 1
            while len(at := at[at + d < len(key)]) and len(at := at[key[at] == key[at + d]]):
                good = at[compatible(level[at], place[at], level[at + d], place[at + d], similarity)]
                keep[good] = keep[good + d] = True
                d += 1
            key, node = key[keep].astype(np.int64), node[keep]
            for i in range(0, len(key), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 50_000]), pa.array(node[i : i + 50_000])], ["key", "node"])

    return run


def _close(odd: _Parities, size: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """Of pairs of rows, those that may be as similar by their sizes and parities, which rule out none that are; and how many bits differ."""
    good = np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-6
    x, y = x[good], y[good]
    far = odd.far(x, y)
    good = far <= (1 - similarity) / (1 + similarity) * (size[x] + size[y]) + 1e-6
    return x[good], y[good], far[good]


def _pairs(size: np.ndarray, side: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a tile that may be alike by size and are of different sides where it has two, some rows at a time."""
    by, both = np.argsort(size, kind="stable"), side.min() != side.max()
    for i in range(0, len(by), _ROWS):
        rows = np.arange(i, min(i + _ROWS, len(by)))
        stop = int(np.searchsorted(size[by], size[by[rows[-1]]] / similarity + 1, "right"))
        for j in range(i, stop, _ROWS):
            x, y = np.meshgrid(rows, np.arange(j, min(j + _ROWS, stop)), indexing="ij")
            x, y = x.ravel(), y.ravel()
            good = x < y
            x, y = by[x[good]], by[y[good]]
            if both:
                across = side[x] != side[y]
                x, y = x[across], y[across]
            yield x, y


def _hopeful(similarity: float, small: int = 48):
    """The rows of a tile that have a partner of another component within the bounds, across the sides where it has two."""

    def out(held: list[pa.RecordBatch], large: bool) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        odd, size, own, side = _Parities(t.column("odd").to_pylist()), t.column("size").to_numpy().astype(np.int64), t.column("component").to_numpy(), t.column("side").to_numpy()
        partner = np.zeros(len(size), bool)
        for x, y in _pairs(size, side, similarity) if large else [_small_pairs(t.column("tile").to_numpy())]:
            apart = own[x] != own[y]
            x, y, _ = _close(odd, size, x[apart], y[apart], similarity)
            partner[x] = partner[y] = True
        return t.drop_columns(["odd"]).filter(pa.array(partner)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, group in _grouped(batches):
            rows = sum(len(x) for x in group)
            if rows > small:
                yield from out(group, True)
            elif rows > 1:
                held += group
                n += rows
                if n > 10_000:
                    yield from out(held, False)
                    held, n = [], 0
        if held:
            yield from out(held, False)

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray | None:
    """Sets as rows of packed bits, over the members that more than one has; none if that is too large."""
    sizes = [len(x) for x in sets]
    member, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    keep = n[place] > 1
    width = -(-int((n > 1).sum()) // 64) * 64
    if len(sets) * width // 8 > PACKED_BYTES:
        return None
    bits = np.zeros((len(sets), max(width, 64) // 8), np.uint8)
    row, at = np.repeat(np.arange(len(sets)), sizes)[keep], column[place[keep]]
    np.bitwise_or.at(bits, (row, at >> 3), np.left_shift(1, at & 7).astype(np.uint8))
    return bits.view(np.uint64)


def _verified(similarity: float):
    """A forest of components with a pair within the bounds whose shingle sets are as similar; pairs that it connects already aren't looked at."""

    def compare(t: pa.Table) -> pa.RecordBatch:
        side = t.column("side").to_numpy()
        sets = [_unpacked_set(x.as_py()) for x in t.column("set")]
        size, odd = np.array([len(x) for x in sets]), _Parities([parity(x) for x in sets])
        node, first, own = np.unique(t.column("component").to_numpy(), return_index=True, return_inverse=True)
        node, root = node[own], first[own]
        packed = _shared(sets) if len(sets) > 32 else None
        chunk = 2048 if packed is None else min(2048, max(64, PAIR_BYTES // packed[0].nbytes))
        a, b = [], []
        for x, y in _pairs(size, side, similarity):
            apart = root[x] != root[y]
            x, y, far = _close(odd, size, x[apart], y[apart], similarity)
            by = np.argsort(far, kind="stable")
            x, y = x[by], y[by]
            for k in range(0, len(x), chunk):
                u, v = x[k : k + chunk], y[k : k + chunk]
                apart = root[u] != root[v]
                u, v = u[apart], v[apart]
                if not len(u):
                    continue
                if packed is None:
                    same = np.array([len(np.intersect1d(sets[m], sets[n], assume_unique=True)) for m, n in zip(u.tolist(), v.tolist(), strict=True)])
                else:
                    same = np.bitwise_count(packed[u] & packed[v]).sum(axis=1, dtype=np.int64)
                good = same >= similarity * (size[u] + size[v] - same)
                u, v = u[good], v[good]
                if len(u):
                    a.append(node[u]), b.append(node[v])
                    root = local_roots(np.concatenate([np.arange(len(root)), u]), np.concatenate([root, v]), len(root))
        empty = [np.zeros(0, np.int64)]
        a, b = np.concatenate(a or empty), np.concatenate(b or empty)
        if len(a) > len(node):  # a forest says as much
            moved = root != np.arange(len(root))
            a, b = node[moved], node[root[moved]]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches):
            yield compare(pa.Table.from_batches(held))

    return run


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(tile, node, side) of the comparisons of rows (key, node, size, component, level); sizes: key, n, shingles.

    A key is a tile. One of too many rows or shingles is split by level of size and, where a component has
    many of its rows, by component, then by hash; pairs of such parts are tiles of two sides, but for parts of one
    component and for levels too far apart. What is used several times is written once: as one plan, it would repeat
    all before it at each use, which the driver holds and plans anew after each of its shuffles.
    """
    sizes = written(sizes)
    large = (F.col("n") > 2 * TILE) | (F.col("shingles") > TILE_SHINGLES)
    cold = rows.join(sizes.where(~large).select("key"), "key").select(F.xxhash64("key").alias("tile"), "node", F.lit(0).alias("side"))
    hot = rows.join(sizes.where(large).select("key"), "key")
    whole = hot.groupBy("key", "component").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("key", "component", F.lit(True).alias("whole"))
    hot = written(hot.join(whole, ["key", "component"], "left").withColumn("label", F.when(F.col("whole"), F.col("component")).otherwise(-1)).drop("whole"))
    parts = hot.groupBy("key", "level", "label").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("shingles"))
    parts = written(parts.select("key", "level", "label", F.ceil(F.greatest(F.col("n") / TILE, F.col("shingles") * 2 / TILE_SHINGLES)).cast("int").alias("parts")))
    hot = hot.join(parts, ["key", "level", "label"]).withColumn("t", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    one = parts.select("key", "level", "label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("t"))
    two = one.select("key", *[F.col(c).alias(f"{c}2") for c in ("level", "label", "t")])
    apart = (F.col("label") == -1) | (F.col("label") != F.col("label2"))
    forward = F.struct("level", "label", "t") <= F.struct("level2", "label2", "t2")
    pairs = one.join(two, "key").where(forward & apart & (F.col("level2") - F.col("level") <= 1)).withColumn("tile", F.xxhash64("key", "level", "label", "t", "level2", "label2", "t2"))
    left = F.struct("level", "label", "t", F.lit(0).alias("side"))
    right = F.struct(*[F.col(f"{c}2").alias(c) for c in ("level", "label", "t")], F.lit(1).alias("side"))
    itself = F.struct("level", "label", "t") == F.struct("level2", "label2", "t2")
    sides = pairs.select("key", "tile", F.explode(F.when(itself, F.array(left)).otherwise(F.array(left, right))).alias("s")).select("key", "tile", "s.*")
    return cold.union(hot.join(sides, ["key", "level", "label", "t"]).select("tile", "node", "side"))


def _missed_links(texts: DataFrame, nodes: DataFrame, roots: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (a, b) between components of the roots that hold a pair of the similarity: every such pair is looked at."""
    spark = texts.sparkSession
    common = spark.sparkContext.broadcast(rarity(texts, words))
    own = nodes.where("size > 0").select("node", "r", F.col("rid").alias("at"))
    asked = texts.join(own.hint("shuffle_hash"), (texts["r"] == own["r"]) & (texts["rid"] - own["at"] == 0)).select("text", "node")
    shingles = nodes.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    shards = max(partitions(spark) * 4, int((1 - similarity) * shingles) // SHARD_KEYS)
    packed = asked.mapInArrow(_prefixes(words, similarity, common, shards), "shard int, packed binary")
    met = packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(_met(similarity), "key long, node long")
    known = nodes.join(roots, "node", "left").select("node", "size", F.coalesce("component", "node").alias("component"))
    rows = written(met.join(known, "node").select("key", "node", "size", "component"))
    marks = [F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("shingles"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in range(2)]]
    keys = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), *marks).where("low < high")
    keys = keys.groupBy("n", "x0", "x1").agg(F.min("key").alias("key"), F.first("shingles").alias("shingles")).select("key", "n", "shingles")
    # sizes of similar sets are in the same or neighbouring powers of 1 / similarity, a little more for rounding
    level = F.floor(F.log("size") / F.lit(float(np.log(1 / similarity)) * 1.001)).cast("int")
    dealt = _dealt(rows.withColumn("level", level), keys)
    fact = nodes.join(roots, "node", "left").select("node", "r", F.col("rid").alias("at"), "size", F.coalesce("component", "node").alias("component"), "odd")
    points = dealt.join(fact, "node").select("tile", "side", "r", "at", "size", "component", "odd")
    left = points.repartition("tile").sortWithinPartitions("tile").mapInArrow(_hopeful(similarity), "tile long, side int, r long, at long, size int, component long")
    left = written(left)
    sets = texts.join(left.hint("shuffle_hash"), (texts["r"] == left["r"]) & (texts["rid"] - left["at"] == 0)).select("text", "tile", "side", "component")
    sets = sets.mapInArrow(_sent(words), "tile long, side int, component long, set binary")
    return sets.repartition("tile").sortWithinPartitions("tile").mapInArrow(_verified(similarity), "a long, b long")


# the whole


def _classes(docs: DataFrame, words: int, similarity: float, lanes: int, mins: int) -> tuple[DataFrame, DataFrame]:
    """The table of rows (r, rid, c0, c1, ... for the columns of docs), and r, rid, doc_id, component and kept of those that aren't alone."""
    spark = docs.sparkSession
    arrow_batches(spark)
    names = docs.columns
    columns = [F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(names)]
    text, doc_id = f"c{names.index('text')}", f"c{names.index('doc_id')}"
    # where a row lies follows from what it holds, so that a task that runs again deals it alike; which row it is, from the table
    rows = bucketed(docs.select(*columns).withColumn("r", F.xxhash64(doc_id, text)), "r", "rid")
    texts = rows.select("r", "rid", F.col(text).alias("text"))
    bits = [f"b{k}" for k in range(lanes)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"rid long, r long, doc_id {kind}, one long, two long, size int", *[f"{b} long" for b in bits], "least array<long>, odd binary"])
    prints = written(rows.select("rid", "r", F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_sketched(words, lanes, mins), schema))
    # null ids come first; equal ids in the order of their texts' hashes
    first = F.min(F.struct("doc_id", "rid", "r", "size", *bits, "least", "odd")).alias("o")
    owners = prints.groupBy("one", "two").agg(first, F.count("*").alias("n"))
    nodes = written(owners.select("one", "two", "n", "o.*").withColumn("node", F.monotonically_increasing_id()))
    roots = written(components(_first_links(texts, nodes, words, similarity, lanes)))
    joined = components(_missed_links(texts, nodes, roots, words, similarity)).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    own = nodes.select("one", "two", "n", "node", "doc_id", "rid").join(roots, "node", "left").withColumn("found", F.col("component").isNotNull()).withColumn("component", F.coalesce("component", "node"))
    own = own.join(joined, "component", "left").where("n > 1 or found or whole is not null").withColumn("whole", F.coalesce("whole", "component"))
    own = written(own.select("one", "two", "whole", "doc_id", "rid"))
    best = own.groupBy("whole").agg(F.min(F.struct("doc_id", "one", "two", "rid")).alias("best"))
    best = own.select("one", "two", "whole").join(best, "whole").select("one", "two", "best")
    judged = prints.select("one", "two", "r", "rid", "doc_id").join(best, ["one", "two"])
    return rows, judged.select("r", "rid", "doc_id", F.col("best.doc_id").alias("component"), (F.col("rid") == F.col("best.rid")).alias("kept"))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 4, mins: int = 6) -> DataFrame:
    """(node, component) of the documents that others are near to: the doc_id, and the smallest doc_id that it reaches.

    Two texts are near if the Jaccard similarity of their sets of `words`-word shingles (A-Z in lower case; fewer
    words are one shingle) is `similarity` or more, or if their words are the same. Null, empty and blank texts
    have the same, no words. Every row of docs that isn't alone comes back once; rows of one doc_id with different texts are told apart.
    A null doc_id counts as the smallest. Other columns are not read. `lanes` and `mins` are the first pass's
    fingerprint words and least hashes; they don't change the result.
    """
    _, judged = _classes(docs.select("doc_id", "text"), words, similarity, lanes, mins)
    return judged.select(F.col("doc_id").alias("node"), "component")


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each near-duplicate group (see `similar_groups`): that of the smallest doc_id, null first.

    Of several texts with that doc_id the one of least hash stays, and of rows that repeat both one, whichever. Of
    documents without words one stays. Rows come back as they were with all their columns, whatever those are called;
    an empty table comes back empty.
    """
    rows, judged = _classes(docs, words, similarity, 4, 6)
    gone = judged.where("not kept").select(F.col("r").alias("gone"), F.col("rid").alias("gone_rid"))
    left = rows.join(gone.hint("shuffle_hash"), (F.col("r") == F.col("gone")) & (F.col("rid") - F.col("gone_rid") == 0), "left_anti")
    return left.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
