"""Vector code compression: codebooks of vector parts, nearest entries found through lower bounds of segment means."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import quoted, written

#: Components as integers may be this large, so that squared distances of a vector stay within 64 bits.
MOST = 1 << 26
#: Values of a label up to which their sums are sent to all tasks; beyond, rows are shuffled by label.
BROADCAST_LABELS = 100_000
#: Vectors that one numpy pass holds.
PASS = 4096


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end: equal ones, or as near to that as its length allows."""
    edge = [length * k // parts for k in range(parts + 1)]
    return list(zip(edge[:-1], edge[1:], strict=True))


def segments(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's blocks: the size, the mean, and the norm of what the mean leaves."""
    cut = bounds(x.shape[1], blocks)
    size = np.array([b - a for a, b in cut], np.float64)
    mean = np.stack([x[:, a:b].mean(axis=1) for a, b in cut], axis=1)
    rest = np.stack([np.sqrt(((x[:, a:b] - x[:, a:b].mean(axis=1, keepdims=True)) ** 2).sum(axis=1)) for a, b in cut], axis=1)
    return size, mean, rest


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of `book` to each row of x and the squared distance, both exact; ties to the lower index.

    The squared distance of two blocks is at least size (mean - mean)^2 + (norm - norm)^2, of what the means leave. One block bounds all
    pairs; the entry of the least bound gives each row a distance that the nearest can't exceed; pairs whose bound is above go. Blocks are
    halved and the pairs that stay are bounded anew, until blocks are of one component; then integers decide. Bounds are lowered by more
    than their rounding, so no pair goes that could be nearest or tie.
    """
    length = x.shape[1]
    if not length:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    top = float(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    slack = 1e-9 * (1.0 + length * top * top)
    size, mx, rx = segments(x, 1)
    _, mc, rc = segments(book, 1)
    low = size[0] * (mx - mc.T) ** 2 + (rx - rc.T) ** 2
    seed = low.argmin(axis=1)
    most = ((x - book[seed]) ** 2).sum(axis=1)
    row, entry = np.nonzero(low <= most[:, None] + slack)
    blocks = 2
    while blocks < length:
        size, mx, rx = segments(x, blocks)
        _, mc, rc = segments(book, blocks)
        low = (size * (mx[row] - mc[entry]) ** 2 + (rx[row] - rc[entry]) ** 2).sum(axis=1)
        stays = low <= most[row] + slack
        row, entry, blocks = row[stays], entry[stays], 2 * blocks
    away = ((x[row] - book[entry]) ** 2).sum(axis=1)
    order = np.lexsort((entry, away, row))
    first = order[np.searchsorted(row[order], np.arange(len(x)))]
    return entry[first], away[first]


def _integers(column: pa.Array, length: int) -> np.ndarray:
    """floor(256 x) of vectors of one length."""
    flat = np.floor(256.0 * column.flatten().cast(pa.float64()).to_numpy()).reshape(len(column), length)
    if np.abs(flat).max(initial=0) > MOST:
        raise ValueError(f"a component is beyond {MOST // 256}, where squared distances leave 64 bits")
    return flat.astype(np.int64)


def kept_vectors(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, vec, label of the rows whose vector is there, all of finite numbers."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(quoted(id_)).alias("id"), F.col(quoted(vector)).cast("array<double>").alias("vec"), F.col(quoted(label)).alias("label")).where(F.col("vec").isNotNull() & finite)


def codebooks(kept: DataFrame, length: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The books of all parts: the first vectors by id, moved `rounds` times to the mean of what is nearest to them.

    A task sums what it assigns, so each round shuffles a row for each entry and component of a task; the books, parts * entries rows, are all
    that the driver holds.
    """
    first = kept.select("id", "vec").orderBy(F.asc_nulls_last("id"), "vec").limit(entries).collect()
    start = _integers(pa.array([r.vec for r in first], pa.list_(pa.float64())), length)
    cut = bounds(length, parts)
    books = [start[:, a:b].copy() for a, b in cut]
    for _ in range(rounds):
        held = list(books)

        def summed(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums, counts = [np.zeros_like(b) for b in held], [np.zeros(len(b), np.int64) for b in held]
            for batch in batches:
                for i in range(0, len(batch), PASS):
                    x = _integers(batch.column(0).slice(i, PASS), length)
                    for p, (a, b) in enumerate(cut):
                        entry, _ = nearest(x[:, a:b], held[p])
                        counts[p] += np.bincount(entry, minlength=len(held[p]))
                        np.add.at(sums[p], entry, x[:, a:b])
            for p, (s, n) in enumerate(zip(sums, counts, strict=True)):
                used = np.flatnonzero(n)
                if len(used):
                    cells = [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(s[used].tolist(), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cells, ["part", "entry", "n", "s"])

        found = kept.select("vec").mapInArrow(summed, "part int, entry int, n long, s array<long>")
        width = max(b - a for a, b in cut)
        total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(width)])
        books = [b.copy() for b in books]
        for r in total.collect():
            a, b = cut[r.part]
            books[r.part][r.entry] = [r[f"s{j}"] // r.n for j in range(b - a)]
    return books


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label, label_error, codebooks_sha256 of each vector whose components are all finite numbers.

    Components become floor(256 x). A vector's parts are each coded by their nearest entry of that part's codebook, two hex digits each; error is the sum of the squared
    distances, label_error that of all vectors of the label (nulls together), codebooks_sha256 tells the books apart. The books begin as the parts of the
    vectors of the smallest ids (ties by the vector, null ids last) and move `rounds` times to the mean of what they are nearest to, rounded down;
    unused entries stay.

    Null vectors and such with null, NaN or infinite components are left out. So are vectors of another length than that of the smallest id.
    Fewer vectors than entries make smaller books; lengths that parts don't divide give parts as equal as can be. Repeated rows count as often as they are there. An empty
    table gives an empty one. Components beyond 2^18 raise, as their squares leave 64 bits. Other columns are not read.
    """
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    spark: SparkSession = vectors.sparkSession
    kept = kept_vectors(vectors, id_, vector, label)
    one = kept.orderBy(F.asc_nulls_last("id"), "vec").select(F.size("vec").alias("n")).head(1)
    if not one:
        kind = dict(kept.dtypes)
        return spark.createDataFrame([], f"vec_id {kind['id']}, code string, error long, label {kind['label']}, label_error long, codebooks_sha256 string")
    length = one[0].n
    kept = kept.where(F.size("vec") == length)
    books = codebooks(kept, length, parts, entries, rounds)
    cut = bounds(length, parts)
    digest = hashlib.sha256(",".join(str(v) for book in books for row in book.tolist() for v in row).encode()).hexdigest()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), PASS):
                piece = batch.slice(i, PASS)
                x = _integers(piece.column(1), length)
                code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for p, (a, b) in enumerate(cut):
                    entry, away = nearest(x[:, a:b], books[p])
                    code[:, p] = entry
                    error += away
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([c.tobytes().hex() for c in code]), pa.array(error), piece.column(2)], ["vec_id", "code", "error", "label"])

    kind = dict(kept.dtypes)
    rows = written(kept.mapInArrow(coded, f"vec_id {kind['id']}, code string, error long, label {kind['label']}"))
    sums = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    side = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    joined = rows.join(side, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label", "label_error", F.lit(digest).alias("codebooks_sha256"))


_NEAR = """min(struct_pack(q := (x.a - k.a) * (x.a - k.a) + (x.b - k.b) * (x.b - k.b) + (x.c - k.c) * (x.c - k.c) + (x.d - k.d) * (x.d - k.d), i := k.i)) m"""
_MEANS = ", ".join(f"cast(floor(sum({c}) / count(*)) as bigint) {c}" for c in "abcd")
_ROUND = f"""a{{1}} as materialized (select x.vec_id, x.p, {_NEAR} from x join b{{0}} k using (p) group by x.vec_id, x.p),
m{{1}} as (select p, n.m.i i, {_MEANS} from a{{1}} n join x using (vec_id, p) group by p, n.m.i),
b{{1}} as materialized (select p, i, {", ".join(f"coalesce(m{{1}}.{c}, b{{0}}.{c}) {c}" for c in "abcd")} from b{{0}} left join m{{1}} using (p, i)),"""
SQL = f"""
with v as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
x as materialized (select vec_id, p.p p, e[p.p * 4 + 1] a, e[p.p * 4 + 2] b, e[p.p * 4 + 3] c, e[p.p * 4 + 4] d from v, range(0, 16) p(p)),
b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 i, a, b, c, d from x qualify i < 64),
{_ROUND.format(0, 1)}
{_ROUND.format(1, 2)}
last as (select x.vec_id, x.p, {_NEAR} from x join b2 k using (p) group by x.vec_id, x.p),
coded as (select vec_id, string_agg(lower(printf('%02x', m.i)), '' order by p) code, cast(sum(m.q) as bigint) error from last group by vec_id),
books as (select sha256(string_agg(concat_ws(',', a, b, c, d), ',' order by p, i)) s from b2)
select vec_id, code, error, label, cast(sum(error) over (partition by label) as bigint) label_error, (select s from books) codebooks_sha256 from coded join v using (vec_id)
"""
