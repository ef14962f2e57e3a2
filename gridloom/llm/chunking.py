"""Removal of repeated content-defined chunks: gear rolling hash, digests, first owner by document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_batches, mix64, passes, utf8
from gridloom.llm.suffix import NULL_ID, remove_spans

_GEAR = (mix64(np.arange(11, 267, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
#: Bytes that one gear hash depends on: each shift drops the oldest bit of 32.
WINDOW = 32
MAP_BYTES = 4 << 20
CHUNK = "one long, two long, doc_id long, start int, stop int, settled boolean"


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, h = (h << 1) + table[byte], over the last 32 bytes, by doubling."""
    h, k = _GEAR[data], 1
    while k < WINDOW:
        h[k:] += h[:-k] << np.uint32(k)
        k *= 2
    return h


def boundaries(data: np.ndarray, ends: np.ndarray, bits: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of all chunks: cuts where the hash's top bits are zero, at least `least` bytes apart.

    Where none comes for `most` bytes, there is one; so no chunk is longer than both together. A
    document's last chunk may be shorter than `least`.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(gear(data) >> np.uint32(32 - bits) == 0) + 1
    # documents' ends are cuts too, and so is every `most` bytes after a cut that no other follows
    marks = np.union1d(cuts, ends)
    gap = np.diff(marks)
    more = (gap - 1) // most
    step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    marks = np.sort(np.concatenate([marks, np.repeat(marks[:-1], more) + step * most]))
    following = np.searchsorted(marks, marks + least).tolist()
    at = np.searchsorted(marks, ends).tolist()
    starts, stops, values = [], [], marks.tolist()
    for first, last in zip(at[:-1], at[1:], strict=True):
        i = first
        while i < last:
            j = min(following[i], last)
            starts.append(values[i])
            stops.append(values[j])
            i = j
    return np.array(starts, np.int64), np.array(stops, np.int64)


def _chunks(bits: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, ends = utf8(batch.column(1))
            for i, j in passes(ends, MAP_BYTES):
                part, own = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
                start, stop = boundaries(part, own, bits, least, most)
                if not len(start):
                    continue
                row = np.searchsorted(own, start, "right") - 1
                doc, text = ids[i:j][row], part.tobytes()
                digest = xxhash.xxh3_128_digest
                both = np.frombuffer(b"".join([digest(text[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
                by = np.lexsort((doc, both[:, 1], both[:, 0]))
                one, two, owner = both[by, 0], both[by, 1], doc[by]
                new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
                # an earlier owner in the same pass settles it: such rows are dealt by document, not by digest
                settled = owner > owner[np.flatnonzero(new)[np.cumsum(new) - 1]]
                one = np.where(settled, mix64(owner.view(np.uint64)), one)
                two = np.where(settled, mix64(start[by].view(np.uint64)), two)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(owner), pa.array((start - own[row])[by].astype(np.int32)), pa.array((stop - own[row])[by].astype(np.int32)), pa.array(settled)],
                    ["one", "two", "doc_id", "start", "stop", "settled"],
                )

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of digest and document those that aren't of a digest's first document; nothing is held but that document."""
    last = owner = None
    for batch in batches:
        if not len(batch):
            continue
        one, two, doc, start, stop, settled = batch.columns
        one, two, who = (x.to_numpy() for x in (one, two, doc))
        new = np.ones(len(who), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        new[0] = last != (one[0], two[0])
        first = who[np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))]
        if not new[0]:
            first[np.cumsum(new) == 0] = owner
        last, owner = (one[-1], two[-1]), first[-1]
        gone = pa.array(settled.to_numpy(zero_copy_only=False) | (who > first))
        yield pa.RecordBatch.from_arrays([doc.filter(gone), start.filter(gone), stop.filter(gone)], ["doc_id", "start", "stop"])


def repeated_chunks(docs: DataFrame, bits: int = 5, least: int = 32, most: int = 1024) -> DataFrame:
    """(doc_id, start, stop) of the chunks whose digest a document of smaller doc_id has."""
    arrow_batches(docs.sparkSession, rows=4000, size=16 << 20)
    texts = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text")
    chunks = texts.mapInArrow(_chunks(bits, least, most), CHUNK)
    # a chunk's rows stream past its first owner, however many they are
    dealt = chunks.repartition("one", "two").sortWithinPartitions("one", "two", "doc_id")
    return dealt.mapInArrow(_later, "doc_id long, start int, stop int")


def remove_chunks(docs: DataFrame, bits: int = 5, least: int = 32, most: int = 1024, run: int = 0, keep_text: bool = False) -> DataFrame:
    """Removes the content-defined chunks that a document of smaller doc_id has too.

    Chunks end where the top `bits` bits of the gear hash of the last 32 bytes are zero, `least` to `most`
    bytes apart (2**bits + least on average), so an insertion moves only the cuts beside it. Of repeated
    chunks that touch, fewer than `run` bytes together stay. Gives doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 and, where asked for, kept_text. Null and empty texts have no chunks. doc_id identifies a
    document: repeated rows give repeated results, and texts that share an id are one document's, cut at the places that
    any of them loses; a null doc_id counts as the smallest, so it loses nothing. Other columns are
    not read. An empty table gives an empty one.
    """
    return remove_spans(docs.select("doc_id", "text"), repeated_chunks(docs, bits, least, most), keep_text, run)
