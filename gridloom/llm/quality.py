"""Quality scores by nearest labelled neighbours in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import PASS_BYTES, arrow_batches, quoted, utf8

#: Hashed byte trigrams that a text is counted in.
BUCKETS = 2048
#: Labelled texts of each class that the space is fitted on and that vote: the bound of the model.
SAMPLE = 1000
DIMENSIONS = 64
NEIGHBOURS = 15
#: Similarities count to this power, so that close neighbours outvote far ones.
SHARPNESS = 4
_ROWS = 512


def trigram_counts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often each hashed byte trigram is in each text; trigrams across texts are left out."""
    n = len(ends) - 1
    out = np.zeros(n * BUCKETS, np.float32)
    for at in range(0, max(len(data) - 2, 0), PASS_BYTES):
        x = data[at : at + PASS_BYTES + 2].astype(np.uint32)
        if len(x) < 3:
            break
        code = ((x[:-2] * np.uint32(65599 * 65599 & 0xFFFFFFFF) + x[1:-1] * np.uint32(65599) + x[2:]) * np.uint32(2654435761)) >> np.uint32(21)
        place = np.arange(at, at + len(code))
        doc = np.searchsorted(ends, place, "right") - 1
        whole = place + 2 < ends[doc + 1]
        first, last = doc[0], doc[-1]
        cell = (doc[whole] - first) * BUCKETS + code[whole]
        out[first * BUCKETS : (last + 1) * BUCKETS] += np.bincount(cell, minlength=(last - first + 1) * BUCKETS)
    return out.reshape(n, BUCKETS)


def weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Log counts by rarity, of unit length; a text without trigrams stays zero."""
    x = np.log1p(counts) * rarity
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, ends = utf8(batch.column(1))
        for i in range(0, len(batch), _ROWS):
            part = ends[i : i + _ROWS + 1]
            counts = trigram_counts(data[part[0] : part[-1]], part - part[0])
            rows = [pa.array([x.tobytes() for x in counts], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, _ROWS), *rows, batch.column(2).slice(i, _ROWS)], ["doc_id", "counts", "good"])


def learn(docs: DataFrame, labels: DataFrame, learnable, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The latent space and the labelled vectors in it, from at most `sample` texts of each class.

    labels: doc_id, quality (null: not a label). Several labels of a document count as their mean, rounded.
    The sample is the labelled documents of least hash, so it is the same in any order of the rows.
    """
    arrow_batches(docs.sparkSession)
    marked = labels.where(learnable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("good"))
    marked = marked.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = None
    for good in (0, 1):
        some = marked.where(F.col("good") == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.union(some)
    # at most twice `sample` ids, so that this side is small enough to be sent to all tasks
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # of several texts with one id, that of least hash
    texts = texts.groupBy("doc_id", "good").agg(F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit("")).alias("text"))).alias("t"))
    rows = texts.select("doc_id", F.col("t.text").alias("text"), "good").mapInArrow(_counted, "doc_id long, counts binary, good int").toArrow().sort_by("doc_id")
    counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.float32).reshape(-1, BUCKETS)
    good = rows.column("good").to_numpy().astype(np.float64)
    n = len(good)
    rarity = (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = weighted(counts, rarity)
    # the leading right singular vectors, by subspace iteration from a fixed start
    basis = np.random.default_rng(5).standard_normal((BUCKETS, DIMENSIONS + 8)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, vectors = np.linalg.eigh((x @ basis).T @ (x @ basis))
    space = (basis @ vectors[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
    return {"rarity": rarity, "space": space, "vectors": _unit(x @ space), "good": good}


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 1e-6, norm, 1)).astype(np.float32)


def vote(model: dict[str, np.ndarray], counts: np.ndarray) -> np.ndarray:
    """Exact cosines of a block of texts with all labelled vectors; the nearest vote by similarity.

    A text without a similar neighbour, so an empty one, gets the share of good texts in the sample.
    """
    good, labelled = model["good"], model["vectors"]
    prior = good.mean() if len(good) else 0.5
    if not len(good):
        return np.full(len(counts), prior)
    near = _unit(weighted(counts, model["rarity"]) @ model["space"]) @ labelled.T
    k = min(NEIGHBOURS, len(good))
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** SHARPNESS
    return np.clip(((weight * good[top]).sum(axis=1) + 1e-3 * prior) / (weight.sum(axis=1) + 1e-3), 0, 1)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(len(batch.schema) - 1))
            score = np.zeros(len(batch))
            for i in range(0, len(batch), _ROWS):
                part = ends[i : i + _ROWS + 1]
                score[i : i + _ROWS] = vote(model.value, trigram_counts(data[part[0] : part[-1]], part - part[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, learnable=None, keep: tuple[str, ...] = ("doc_id",), added: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The `keep` columns of docs with score (0 to 1, higher: quality 1 likelier) and predicted (score >= 0.5).

    Texts are counted in hashed byte trigrams and projected on latent dimensions fitted on a bounded sample
    of the labelled texts (SAMPLE of each class); those vectors, whose size the bound fixes, are broadcast,
    and each text's exact cosines with all of them choose the neighbours that vote. learnable: a condition
    on the labels' doc_id that says which may be learnt from. Null and empty texts get the sample's share
    of good ones; without any usable label every score is 0.5. A doc_id of several texts that is labelled lends
    the one of least hash. Rows of docs come back one for one. `added` names the two new columns, for docs that have columns of those names.
    """
    model = learn(docs, labels, F.lit(True) if learnable is None else learnable)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("scored"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "scored")
    made = rows.mapInArrow(_scored(shared), f"{schema}, score double")
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(added[0]), (F.col("score") >= 0.5).cast("int").alias(added[1]))


def fold(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
