"""Exact removal of byte strings that an earlier document also holds, by ranks at growing offsets.

A suffix array by prefix doubling ranks every position by ever longer prefixes and is done with a
position once its rank is unique or its prefix reaches the threshold. Here Spark deals (rank, position)
pairs by rank, tasks sort them, and three prefix lengths are enough for a threshold of `length` bytes:

1. `seed` bytes. Of each window of `length` bytes the seed with the least hash stands for it
   (a minimizer), so equal windows share a seed at the same offset and about one position in sixteen
   is ranked instead of each. Seeds that one document alone holds drop out.
2. The seed with all bytes of the windows around it. A position whose wider context an earlier document
   holds too is wholly covered.
3. What is left are seeds that stand in more than one context: each context, where the first document has
   it, is ranked again by every window of `length` bytes in it.

Ranks are 64-bit hashes of content (the naming form of prefix doubling), two per decision.
Copies inside one pass of a map task are settled there, so that a passage that a third of all documents
share reaches the shuffle once per pass; seeds with very many contexts are dealt by window, not by seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_batches, mix64, partitions, passes, utf8, written

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_TABLE_2 = mix64(_TABLE ^ np.uint64(0xE7037ED1A0B428DB))
#: Contexts of one seed beyond which its windows are dealt one by one.
HOT_CONTEXTS = 20_000
#: Text that one pass of a map task takes at once; copies within it are settled without a shuffle.
MAP_BYTES = 4 << 20
#: Text whose ranks one key of the shuffle takes on average at most.
KEY_BYTES = 32 << 20
NULL_ID = -(1 << 63)

RANKED = "key int, blob binary"
FOUND = "expand boolean, hot boolean, doc_id long, pos int, rank long"
CONTEXT = "key long, doc_id long, start int, context binary"
SPAN = "doc_id long, start int, stop int"

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        for name, base in (("p", _P), ("i", _P_INVERSE)):
            made = np.full(n, base, np.uint64)
            made[0] = 1
            _powers[name] = np.multiply.accumulate(made)
    return _powers["p"], _powers["i"]


class _Strings:
    """The hash of any substring of `data` from two prefix sums."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _TABLE):
        power, self.inverse = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        length = (stop - start).astype(np.uint64)
        return mix64((self.sums[stop] - self.sums[start]) * self.inverse[start] + length * np.uint64(0x2545F491))

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * self.inverse[:n] + np.uint64(length * 0x2545F491))


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of `width` values, by doubling."""
    k = 1
    while 2 * k <= width:
        x = f(x[: len(x) - k], x[k:])
        k *= 2
    rest = width - k
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def _starts(ends: np.ndarray, n: int, length: int) -> np.ndarray:
    """Whether a window of `length` bytes that starts here stays in its document."""
    step = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(ends) >= length)
    np.add.at(step, ends[long], 1)
    np.add.at(step, ends[long + 1] - length + 1, -1)
    return np.cumsum(step[:n])[: n - length + 1] > 0


def seeds(data: np.ndarray, ends: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """document, position, rank of the seed and rank of its context, for each minimizer."""
    width, n = length - seed + 1, len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    strings = _Strings(data)
    rank = strings.every(seed)
    order = (rank >> np.uint64(32)).astype(np.uint32)
    least = np.where(_starts(ends, n, length), np.maximum(_slide(order, width, np.minimum), 1), 0)
    edge = np.zeros(width - 1, least.dtype)
    most = _slide(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero((most == np.maximum(order, 1)) & (most > 0))
    doc = np.searchsorted(ends, at, "right") - 1
    low, high = np.maximum(at - width + 1, ends[doc]), np.minimum(at + length, ends[doc + 1])
    context = strings.of(low, high) ^ (at - low).astype(np.uint64)
    return doc, at - ends[doc], rank[at], context


def _resolve(doc, pos, rank, context):
    """Sorts by (rank, context, document) and gives the order, the groups' first rows and what is covered."""
    by = np.lexsort((pos, doc, context, rank))
    doc, rank, context = doc[by], rank[by], context[by]
    new_rank = np.concatenate([[True], rank[1:] != rank[:-1]])
    new = new_rank | np.concatenate([[True], context[1:] != context[:-1]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return by, new_rank, new, doc > doc[first]


_ROW = np.dtype([("rank", "<u8"), ("context", "<u8"), ("low", "<u4"), ("high", "<i4"), ("pos", "<i4")])
_FIELDS = (("rank", 7), ("context", 6), ("low", 4), ("high", 4), ("pos", 4))


def _packed(rank, context, doc, pos) -> bytes:
    """Columns one after another, of as many bytes as they need; whole bytes of zeros cost nothing once compressed."""
    out = []
    for (_, size), x in zip(_FIELDS, (rank, context, doc & 0xFFFFFFFF, doc >> 32, pos), strict=True):
        out.append(np.ascontiguousarray(x.astype("<i8" if x.dtype.kind == "i" else "<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes())
    return len(rank).to_bytes(4, "little") + b"".join(out)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:4], "little"), 4, []
    for name, size in _FIELDS:
        x = np.zeros((n, 8), np.uint8)
        x[:, :size] = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T
        x = x.reshape(-1).view(np.uint64)
        out.append(x.astype(np.uint32).view(np.int32).astype(np.int64) if name == "high" else x)
        at += n * size
    rank, context, low, high, pos = out
    return [(high << 32) | low.astype(np.int64), pos.astype(np.int64), rank, context]


def _map(length: int, seed: int, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            data, ends = utf8(batch.column(1))
            for i, j in passes(ends, MAP_BYTES):
                doc, pos, rank, context = seeds(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], length, seed)
                if not len(doc):
                    continue
                # the top bits deal the ranks out, so that 56 of the others identify one
                key = ((rank >> np.uint64(40)) % np.uint64(keys)).astype(np.int64)
                rank, context = rank & np.uint64((1 << 56) - 1), context & np.uint64((1 << 48) - 1)
                doc = ids[i:j][doc]
                by, _, _, covered = _resolve(doc, pos, rank, context)
                doc, pos, rank, context, key = doc[by], pos[by], rank[by], context[by], key[by]
                # settled here: these only travel on to their documents, marked by a key below zero
                key = np.where(covered, -1 - (mix64(doc.astype(np.uint64)) % np.uint64(keys)).astype(np.int64), key)
                by = np.argsort(key, kind="stable")
                doc, pos, rank, context, key = doc[by], pos[by], rank[by], context[by], key[by]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
                blobs = [_packed(rank[a:b] if key[a] >= 0 else rank[a:b] * 0, context[a:b] if key[a] >= 0 else context[a:b] * 0, doc[a:b], pos[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key[cut[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["key", "blob"])

    return run


def _found(expand, hot, doc, pos, rank) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(expand), pa.array(hot), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(rank.view(np.int64))],
        ["expand", "hot", "doc_id", "pos", "rank"],
    )


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows that are sorted by their first column, a key at a time."""
    key, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b > a:
                if held and keys[a] != key:
                    yield key, held
                    held = []
                key = keys[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield key, held


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, held in _grouped(batches):
        blobs = [x.as_py() for b in held for x in b.column(1)]
        doc, pos, rank, context = (np.concatenate(x) for x in zip(*map(_unpacked, blobs), strict=True))
        no = np.zeros(len(doc), bool)
        if key < 0:
            yield _found(no, no, doc, pos, rank)
            continue
        by = np.argsort(rank)  # most ranks are unique and drop out here
        ordered = rank[by]
        same = np.concatenate([[False], ordered[1:] == ordered[:-1]])
        by = by[same | np.concatenate([same[1:], [False]])]
        if not len(by):
            continue
        doc, pos, rank, context = doc[by], pos[by], rank[by], context[by]
        by, new_rank, new, covered = _resolve(doc, pos, rank, context)
        doc, pos, rank = doc[by], pos[by], rank[by]
        group = np.cumsum(new_rank) - 1
        contexts = np.bincount(group, new)
        starts = np.flatnonzero(new_rank)
        several = np.maximum.reduceat(doc, starts) > np.minimum.reduceat(doc, starts)
        # all places of the first document that has a context: their windows may be in a yet smaller one
        expand = ~covered & (contexts[group] > 1) & several[group]
        hot = contexts[group] > HOT_CONTEXTS
        out = covered | expand
        yield _found(expand[out], hot[out], doc[out], pos[out], rank[out])


def _contexts(length: int, seed: int):
    side = length - seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, ends = utf8(batch.column(1))
            keys, docs, starts, found = [], [], [], []
            for i, wanted in enumerate(batch.column(2)):
                text = data[ends[i] : ends[i + 1]].tobytes()
                for x in wanted.as_py():
                    a, b = max(0, x["pos"] - side), min(len(text), x["pos"] + length)
                    if x["hot"]:
                        for s in range(a, b - length + 1):
                            window = text[s : s + length]
                            keys.append(x["rank"] ^ int.from_bytes(hashlib.blake2b(window, digest_size=7).digest(), "little"))
                            docs.append(ids[i]), starts.append(s), found.append(window)
                    else:
                        keys.append(x["rank"]), docs.append(ids[i]), starts.append(a), found.append(text[a:b])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int32()), pa.array(found, pa.binary())],
                ["key", "doc_id", "start", "context"],
            )

    return run


def _windows(length: int):
    """Spans of the windows that the same group holds in a smaller document; groups are never split over passes."""

    def spans(table: pa.Table) -> pa.RecordBatch:
        key = table.column("key").to_numpy()
        doc, start = table.column("doc_id").to_numpy(), table.column("start").to_numpy()
        data, ends = utf8(table.column("context").combine_chunks().cast(pa.large_binary()))
        count = np.maximum(np.diff(ends) - length + 1, 0)
        row = np.repeat(np.arange(len(key)), count)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = ends[row] + offset
        one = _Strings(data).of(at, at + length) ^ mix64(key[row].view(np.uint64))
        two = _Strings(data, _TABLE_2).of(at, at + length)
        by = np.argsort(one)
        ordered = one[by]
        same = np.concatenate([[False], ordered[1:] == ordered[:-1]])
        by = by[same | np.concatenate([same[1:], [False]])]
        by = by[np.lexsort((doc[row[by]], two[by], one[by]))]
        if not len(by):
            return None
        new = np.concatenate([[True], (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])])
        d = doc[row[by]]
        by = by[d > d[np.flatnonzero(new)[np.cumsum(new) - 1]]]
        by = np.sort(by)  # by row and offset again, to join neighbours into one span
        r, s = row[by], start[row[by]] + offset[by]
        if not len(r):
            return None
        cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)]))
        last = np.concatenate([cut[1:], [len(r)]]) - 1
        return pa.RecordBatch.from_arrays([pa.array(doc[r[cut]]), pa.array(s[cut].astype(np.int32)), pa.array((s[last] + length).astype(np.int32))], ["doc_id", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for _, group in _grouped(batches):
            held += group
            rows += sum(len(x) for x in group)
            if rows > 20_000:
                if (out := spans(pa.Table.from_batches(held))) is not None:
                    yield out
                held, rows = [], 0
        if held and (out := spans(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def cut_spans(keep_text: bool, least: int = 0):
    """Applies (doc_id, text, [(start, stop)]): counts and a digest of the bytes that are left, or the text itself.

    Runs of fewer than `least` bytes, once spans that touch are one, stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(1))
            size, removed, runs, digests, kept = np.diff(ends), [], [], [], []
            spans = batch.column(2)
            for i in range(len(batch)):
                text = data[ends[i] : ends[i + 1]]
                if spans[i].is_valid and len(spans[i].values):
                    pair = spans[i].values
                    start, stop = pair.field(0).to_numpy().astype(np.int64), np.minimum(pair.field(1).to_numpy(), len(text))
                    step = np.zeros(len(text) + 1, np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, stop, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    if least:
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                        for a, b in edge.reshape(-1, 2):
                            gone[a:b] = b - a >= least
                    removed.append(int(gone.sum()))
                    runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                    text = text[~gone]
                else:
                    removed.append(0), runs.append(0)
                text = text.tobytes()
                digests.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode("utf-8", "replace") if keep_text else None)
            columns = [batch.column(0), pa.array(size), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, id, text). Both joins of texts deal out these same three columns by id, so that Spark shuffles the texts once and reads them twice."""
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text")


def remove_spans(texts: DataFrame, spans: DataFrame, keep_text: bool = False, least: int = 0) -> DataFrame:
    """Cuts (doc_id, start, stop) byte spans, which may overlap, out of (doc_id, text)."""
    gathered = spans.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = _keyed(texts).join(gathered, "id", "left").select("doc_id", "text", "spans")
    kept = ", kept_text string" if keep_text else ""
    return joined.mapInArrow(cut_spans(keep_text, least), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{kept}")


def repeated_spans(docs: DataFrame, length: int = 50, seed: int = 20) -> DataFrame:
    """(doc_id, start, stop) byte spans, which may overlap, that cover what an earlier document holds too."""
    spark = docs.sparkSession
    arrow_batches(spark, rows=4000, size=16 << 20)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    keys = max(partitions(spark) * 8, size // KEY_BYTES)
    texts = _keyed(docs)
    ranked = texts.select("id", "text").mapInArrow(_map(length, seed, keys), RANKED)
    found = ranked.repartition("key").sortWithinPartitions("key").mapInArrow(_reduce, FOUND)
    found = written(found)
    side = length - seed
    covered = found.where("not expand").select("doc_id", F.greatest(F.col("pos") - side, F.lit(0)).alias("start"), (F.col("pos") + length).alias("stop"))
    asked = found.where("expand").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("pos", "hot", "rank")).alias("asked"))
    # doc_id is named though the task doesn't read it: without it this shuffle of the texts would be another than that of `remove_spans`
    context = texts.join(asked, "id").select("id", "text", "asked", "doc_id").mapInArrow(_contexts(length, seed), CONTEXT)
    windows = context.repartition("key").sortWithinPartitions("key").mapInArrow(_windows(length), SPAN)
    return covered.union(windows)


def _beginnings(first: int):
    """Each position of a text that has `first` bytes before the text's end: document, position, bytes to the end, and those `first` bytes as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, ends = utf8(batch.column(1))
            for i, j in passes(ends, 1 << 18):
                own = ends[i : j + 1] - ends[i]
                flat = np.concatenate([data[ends[i] : ends[j]], np.zeros(8, np.uint8)])
                many = np.maximum(np.diff(own) - first + 1, 0)
                row = np.repeat(np.arange(j - i), many)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                rank = np.zeros(len(row), np.uint64)
                for k in range(first):
                    rank = rank << np.uint64(8) | flat[own[row] + pos + k]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][row]), pa.array(pos.astype(np.int32)), pa.array((np.diff(own)[row] - pos).astype(np.int32)), pa.array(rank.view(np.int64))], ["doc_id", "pos", "left", "rank"])

    return run


def doubled_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """The spans of `repeated_spans` by plain prefix doubling over every position, without a hash: (doc_id, start, stop).

    A position's rank names its first bytes, eight to begin with. Each round joins a position to the rank that lies as many bytes further on and names
    the pair by the first place that has it; positions whose pair no other has are done and leave, until `length` bytes are named. It shuffles about
    135 bytes for each byte of text (the other way: 1.5), so it is for corpora that fit that, and for holding the other way against it.
    """
    arrow_batches(docs.sparkSession, rows=4000, size=16 << 20)
    size = min(8, length)
    texts = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text").where(F.octet_length("text") >= length).distinct()
    # a text's positions follow one another in a task's output, so their places do too
    ranked = texts.mapInArrow(_beginnings(size), "doc_id long, pos int, left int, rank long")
    ranked = written(ranked.withColumn("place", F.monotonically_increasing_id()))
    while size < length:
        step = min(size, length - size)
        size += step
        further = ranked.select((F.col("place") - step).alias("place"), F.col("rank").alias("after"))
        pairs = ranked.where(F.col("left") >= size).join(further, "place")
        names = pairs.groupBy("rank", "after").agg(F.min("place").alias("name"), F.count("*").alias("n")).where("n > 1").drop("n")
        ranked = written(pairs.join(names, ["rank", "after"]).select("doc_id", "pos", "left", F.col("name").alias("rank"), "place"))
    first = ranked.where(F.col("left") >= length).groupBy("rank").agg(F.min("doc_id").alias("first"))
    return ranked.where(F.col("left") >= length).join(first, "rank").where("doc_id > first").select("doc_id", F.col("pos").alias("start"), (F.col("pos") + length).alias("stop"))


def remove_repeats(docs: DataFrame, length: int = 50, seed: int = 20, keep_text: bool = False) -> DataFrame:
    """Removes each byte that a string of `length` bytes covers which also starts in a document of smaller doc_id.

    Gives doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, where asked for,
    kept_text (bytes cut inside a character come out as U+FFFD). Strings are judged on the input and never
    cross documents. Null and empty texts have no bytes; texts under `length` bytes lose none. doc_id
    identifies a document: repeated rows give repeated results and don't remove each other, and texts that share an id
    are one document's, cut at the places that any of them loses; a null doc_id counts as the smallest, so it loses nothing. Other columns are not read. An empty table gives an empty one.
    """
    return remove_spans(docs.select("doc_id", "text"), repeated_spans(docs, length, seed), keep_text)
