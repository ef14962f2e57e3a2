"""Context-triggered piecewise hashing: fingerprints of texts, their likeness, and a check against an edit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_batches, mix64, partitions
from gridloom.llm.suffix import NULL_ID

_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_VALUE = np.zeros(256, np.int64)
_VALUE[_ALPHABET] = np.arange(64)
_BYTE = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)).astype(np.uint32)
#: Characters of a signature at most; the last one stands for all that is left.
LENGTH = 64
#: Stands for the place after all documents; ids are below it.
LAST_ID = (1 << 63) - 1
#: Bytes that the rolling hash sees.
WINDOW = 8
_MULTIPLIER = 0x01000193


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last 8 bytes at each position, by doubling; bytes before the text count as zero."""
    h, k, m = _BYTE[data], 1, _MULTIPLIER
    while k < WINDOW:
        h[k:] += h[:-k] * np.uint32(m)
        k, m = 2 * k, m * m & 0xFFFFFFFF
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def _signature(hashes: np.ndarray, block: int) -> bytes:
    """One character for each chunk: chunks end where the rolling hash triggers at this block size."""
    cut = np.flatnonzero((hashes & np.uint32(block - 1)) == block - 1)[: LENGTH - 1] + 1
    start = np.concatenate([[0], cut])
    if start[-1] == len(hashes):
        start = start[:-1]
    # the chunk's hash adds up scrambled windows, so it follows its bytes and their order
    piece = np.add.reduceat(hashes * np.uint32(0x9E3779B1), start, dtype=np.uint32)
    return _ALPHABET[(piece >> np.uint32(26)).astype(np.int64)].tobytes()


def fingerprint(data: bytes) -> tuple[int, bytes, bytes]:
    """Block size, the signature at it and the one at twice it; no bytes: (1, empty, empty)."""
    if not data:
        return 1, b"", b""
    hashes = rolling(np.frombuffer(data, np.uint8))
    block = 1
    while block * LENGTH < len(data):
        block *= 2
    one, two = _signature(hashes, block), _signature(hashes, 2 * block)
    while block > 1 and len(one) < LENGTH // 2:
        block //= 2
        one, two = _signature(hashes, block), one
    return block, one, two


def distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Edit distances of pairs of signatures, bit-parallel over the characters of one and side by side over the pairs."""
    n = len(a)
    long_a, long_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    left = np.zeros((n, LENGTH), np.int64)
    right = np.zeros((n, LENGTH), np.int64)
    inside_a, inside_b = np.arange(LENGTH) < long_a[:, None], np.arange(LENGTH) < long_b[:, None]
    left[inside_a] = _VALUE[np.frombuffer(b"".join(a), np.uint8)]
    right[inside_b] = _VALUE[np.frombuffer(b"".join(b), np.uint8)]
    row, one = np.arange(n), np.uint64(1)
    equal = np.zeros((n, 64), np.uint64)
    for i in range(LENGTH):
        equal[row, left[:, i]] |= np.where(inside_a[:, i], one << np.uint64(i), np.uint64(0))
    plus, minus, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), long_a.copy()
    last = one << np.maximum(long_a - 1, 0).astype(np.uint64)
    for j in range(int(long_b.max(initial=0))):
        eq = equal[row, right[:, j]]
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(across | plus), plus & across
        live = j < long_b
        score += np.where(live, (up & last > 0).astype(np.int64) - (down & last > 0), 0)
        up, down = (up << one) | one, down << one
        plus, minus = np.where(live, down | ~(vertical | up), plus), np.where(live, up & vertical, minus)
    return np.where(long_a == 0, long_b, np.where(long_b == 0, long_a, score))


def likeness(a: list[tuple], b: list[tuple]) -> np.ndarray:
    """0 to 1 for pairs of fingerprints: 1 less the edit distance's share, best over signatures of one block size.

    Equal fingerprints are alike to 1; block sizes more than a factor of two apart, to 0.
    """
    pairs, owner = [], []
    for i, ((x, x1, x2), (y, y1, y2)) in enumerate(zip(a, b, strict=True)):
        found = [(x1, y1), (x2, y2)] if x == y else [(x2, y1)] if y == 2 * x else [(x1, y2)] if x == 2 * y else []
        found = [(p, q) for p, q in found if p and q]
        pairs += found
        owner += [i] * len(found)
    out = np.zeros(len(a))
    if pairs:
        p, q = [x[0] for x in pairs], [x[1] for x in pairs]
        most = np.maximum(np.array([len(x) for x in p]), np.array([len(x) for x in q]))
        np.maximum.at(out, owner, 1 - distances(p, q) / most)
    out[[i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x == y]] = 1
    return out


def shown(x: tuple) -> str:
    return f"{x[0]}:{x[1].decode()}:{x[2].decode()}"


def _packed(bounds):
    """Texts compressed for their one move, with the range of ids that each is dealt to; guests go to the range before theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            bucket = np.searchsorted(bounds.value, batch.column("id").to_numpy(), "right")
            guest = batch.column("guest").to_numpy(zero_copy_only=False)
            past = batch.column("id").to_numpy() == LAST_ID
            bucket = np.where(guest & ~past, bucket - 1, bucket).astype(np.int32)
            text = pa.array([packer.compress((x or "").encode()) for x in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bucket), text], ["id", "named", "guest", "tie", "bucket", "packed"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of documents in ascending doc_id; each ends with a guest, the first document of the next one."""
    last, unpacker = None, zstandard.ZstdDecompressor()
    for batch in batches:
        ids, out = [], {k: [] for k in ("n_chars", "edited_sha256", "own", "edited", "next")}
        for bucket, guest, id_, named, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = unpacker.decompress(packed)
            text, doc_id = data.decode(), id_ if named else None
            own = fingerprint(data)
            if last is not None and last[0] == bucket:
                _, before_id, before, before_print = last
                n = len(before) // 4
                edited = (before[: len(before) - n] + text[:n]).encode()
                ids.append(before_id)
                out["n_chars"].append(len(before))
                out["edited_sha256"].append(hashlib.sha256(edited).hexdigest())
                out["own"].append(before_print), out["edited"].append(fingerprint(edited)), out["next"].append(own)
            last = None if guest else (bucket, doc_id, text, own)
        columns = [
            pa.array(ids, pa.int64()), pa.array(out["n_chars"], pa.int64()), pa.array(out["edited_sha256"], pa.string()),
            pa.array([shown(x) for x in out["own"]], pa.string()), pa.array([shown(x) for x in out["edited"]], pa.string()),
            pa.array(likeness(out["own"], out["edited"])), pa.array(likeness(out["own"], out["next"])),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edit_likeness(docs: DataFrame, ranges: int = 8) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last quarter is the start of the next document's text.

    Gives doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. The next
    document is that of the next doc_id in ascending order (null first, equal ones by a hash of their text), the first after
    the last; null texts are empty. The text moves once, compressed: documents are dealt into ranges of doc_id whose
    bounds are documents themselves, and each of those is also sent, as a guest, to the end of the range
    before. There are `ranges` times as many ranges as partitions, so the list of their bounds grows with the cluster's
    tasks and not with the rows; within a range documents stream past, one held at a time. A single document is its own next. Other columns are not read.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select("doc_id", "text")
    found = rows.agg(F.count("*").alias("rows"), F.min("doc_id").alias("low"), F.count("doc_id").alias("ids")).first()
    buckets = partitions(spark) * ranges
    # quantiles are ids of the table
    bounds = []
    if found["ids"]:
        share = [k / buckets for k in range(1, buckets)]
        bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", share, max(10_000, 20 * buckets))).first()[0]) - {found["low"]})
    # with nulls the first document has none of the ids
    nulls = found["rows"] > found["ids"]
    plain = rows.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col("doc_id").isNotNull().alias("named"), "text", F.lit(False).alias("guest"))
    # of equal ids at a bound, the first by hash is the next one's guest
    starts = F.broadcast(spark.createDataFrame([(x,) for x in bounds], "doc_id long"))
    guests = rows.join(starts, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).alias("text"))
    guests = guests.select(F.col("doc_id").alias("id"), F.lit(True).alias("named"), "text", F.lit(True).alias("guest"))
    first = rows.where(F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(found["low"]))
    first = first.orderBy(F.xxhash64(F.coalesce("text", F.lit("")))).limit(1)
    # it follows the last document: its place is past all bounds
    first = first.select(F.lit(LAST_ID).alias("id"), F.lit(not nulls).alias("named"), "text", F.lit(True).alias("guest"))
    every = plain.union(guests).union(first).withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    packed = every.select("id", "named", "guest", "tie", "text").mapInArrow(_packed(spark.sparkContext.broadcast(np.array(bounds, np.int64))), "id long, named boolean, guest boolean, tie long, bucket int, packed binary")
    order = packed.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "guest", "id", "tie")
    return order.select("bucket", "guest", "id", "named", "packed").mapInArrow(
        _compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
