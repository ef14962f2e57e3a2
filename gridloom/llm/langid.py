"""Language of texts and of spans within them: scripts narrow the languages, Viterbi decodes the words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_batches, passes, quoted

#: The first code point of ranges, by script.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
BUCKETS = 1 << 15
#: Learned texts of each language: the bound of the model.
SAMPLE = 600
#: Languages that are learned, those with the most texts: the other bound.
LANGUAGES = 1000
#: Log-probability that a change of language costs.
SWITCH = 14.0
#: A script that holds less than this share of a language's letters doesn't make it a candidate.
SCRIPT_SHARE = 0.01
#: What a word of a script that a language isn't written in scores, per letter.
FOREIGN = -20.0
_PASS = 1 << 20


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower case, whether it is a letter, or a letter or a mark on one, and its script."""
    everything = [chr(i) for i in range(0x34000)]  # no letters are assigned beyond
    lower = np.arange(0x110000, dtype=np.uint32)
    lower[: len(everything)] = [ord(y) if len(y := x.lower()) == 1 else ord(x) for x in everything]
    letter, mark = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    letter[: len(everything)] = [x.isalpha() for x in everything]
    mark[: len(everything)] = [unicodedata.category(x)[0] == "M" for x in everything]
    script = np.zeros(0x110000, np.uint8)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = i
    return lower, letter, letter | mark, script


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row and where each text begins and ends; null is empty."""
    texts = [x or "" for x in texts]
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def words(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of letters of one script: start, stop, document, script; and each letter's hashed trigram."""
    lower, letter, inside, script = _letters()
    own = inside[flat]
    kind = np.where(own, script[flat], 0)
    # a mark has the script of the letter before it
    kind = np.where(own & ~letter[flat], kind[np.maximum.accumulate(np.where(letter[flat], np.arange(len(flat)), 0))], kind)
    text = np.where(own, lower[flat], 0).astype(np.uint32)
    n = len(flat)
    fresh = np.zeros(n + 1, bool)
    fresh[ends] = True
    first = own.copy()
    first[1:] &= ~own[:-1] | (kind[1:] != kind[:-1]) | fresh[1:n]
    start = np.flatnonzero(first)
    final = own.copy()
    final[:-1] &= ~own[1:] | first[1:] | fresh[1:n]
    stop = np.flatnonzero(final) + 1
    # marks without a letter are no word
    seen = np.concatenate([[0], np.cumsum(letter[flat])])
    empty = seen[stop] == seen[start]
    if empty.any():
        own[np.concatenate([np.arange(a, b) for a, b in zip(start[empty], stop[empty], strict=True)])] = False
        start, stop = start[~empty], stop[~empty]
    before = np.concatenate([[np.uint32(0)], text[:-1]]) if n else text
    after = np.concatenate([text[1:], [np.uint32(0)]]) if n else text
    before[start] = 0
    after[stop - 1] = 0
    gram = (before * np.uint32(0x9E3779B1) + text * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)
    return start, stop, np.searchsorted(ends, start, "right") - 1, kind[start], gram, own, kind


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang in sorted(set(batch.column(1).to_pylist())):
            flat, ends = code_points([t for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if x == lang])
            *_, gram, own, kind = words(flat, ends)
            counts, scripts = np.bincount(gram[own], minlength=BUCKETS), np.bincount(kind[own], minlength=len(SCRIPTS) + 1)
            both = np.concatenate([counts, scripts])
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(both[at].astype(np.int64))], ["lang", "bucket", "n"])


def learn(docs: DataFrame, learnable, sample: int = SAMPLE) -> dict:
    """Trigram log-probabilities and scripts of each language, from about `sample` texts of each.

    Distinct texts are counted, and sampled by their hash against each language's count, so copies weigh
    nothing and no language's rows meet in one task. The LANGUAGES with the most texts are learned, so the model is bounded, and what
    reaches the driver is, by that times buckets.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("text", F.lit(3)).alias("same"))
    sizes = rows.select("lang", "same").distinct().groupBy("lang").agg(F.count("*").alias("rows"))
    chance = F.pmod("same", F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = sizes.orderBy(F.desc("rows"), "lang").limit(LANGUAGES)
    some = rows.join(F.broadcast(sizes), "lang").where(chance * F.col("rows") < sample).dropDuplicates(["lang", "same"]).select("text", "lang")
    counts = some.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((len(langs), BUCKETS + len(SCRIPTS) + 1))
    code = np.searchsorted(langs, counts.column("lang").to_pylist()) if langs else np.zeros(0, int)
    table[code, counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    total = grams.sum(axis=1, keepdims=True)
    log = np.log((grams + 0.5) / (total + 0.5 * BUCKETS))
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return {"langs": langs, "log": np.ascontiguousarray(log.T.astype(np.float32)), "allowed": allowed.T}


def word_scores(model: dict, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, stop, document of each word, and its score in each language; languages of other scripts score FOREIGN."""
    start, stop, doc, script, gram, own, _ = words(flat, ends)
    letters = np.flatnonzero(own)
    log = model["log"][gram[letters]]
    score = np.add.reduceat(log, np.searchsorted(letters, start), axis=0).astype(np.float64) if len(start) else np.zeros((0, len(model["langs"])))
    fits = model["allowed"][script]
    fits |= ~fits.any(axis=1, keepdims=True)
    return start, stop, doc, np.where(fits, score, FOREIGN * (stop - start)[:, None])


def decode(score: np.ndarray, ends: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on the best path of each document; ends: where documents begin in the words.

    A document stays whole in its best language if no run of its words gains more than half the penalty in any
    other: then no path with changes can be better, as k >= 2 runs gain k halves at most and pay k - 1 penalties.
    Viterbi decodes the others side by side.
    """
    n, size = np.diff(ends), score.shape[1]
    out = np.zeros(len(score), np.int64)
    some = np.flatnonzero(n)
    if not len(some) or size < 2:
        return out
    doc = np.repeat(np.arange(len(n)), n)
    best = np.zeros(len(n), np.int64)
    best[some] = np.add.reduceat(score, ends[:-1][some], axis=0).argmax(axis=1)
    out[:] = best[doc]
    gain = score - np.take_along_axis(score, out[:, None], 1)
    total = np.cumsum(gain, axis=0)
    total -= np.concatenate([np.zeros((1, size)), total])[ends[:-1]][doc]
    # the largest gain of a run: the total less the least total before it, document by document
    wall = (np.abs(total).max() + 1) * 4
    low = np.minimum.accumulate(np.minimum(np.concatenate([np.zeros((1, size)), total[:-1]]) * (np.arange(len(score)) != ends[doc])[:, None], 0) - wall * doc[:, None], axis=0) + wall * doc[:, None]
    mixed = np.flatnonzero(np.maximum.reduceat((total - low).max(axis=1), ends[:-1][some]) > switch / 2)
    rows = some[mixed]
    rows = rows[np.argsort(-n[rows], kind="stable")]
    if not len(rows):
        return out
    begin, length = ends[:-1][rows], n[rows]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    value = score[begin]
    back = np.zeros((length.sum(), size), np.int8 if size < 127 else np.int32)
    offset = np.concatenate([[0], np.cumsum(active)])
    same = np.arange(size)
    for t in range(1, length[0]):
        m = active[t]
        last = value[:m]
        top = last.argmax(axis=1)
        jump = np.take_along_axis(last, top[:, None], 1) - switch
        stay = last >= jump
        back[offset[t] : offset[t + 1]] = np.where(stay, same, top[:, None])
        value[:m] = np.where(stay, last, jump) + score[begin[:m] + t]
    state = value.argmax(axis=1)
    for t in range(length[0] - 1, -1, -1):
        m = active[t]
        out[begin[:m] + t] = state[:m]
        if t:
            state[:m] = np.take_along_axis(back[offset[t] : offset[t + 1]], state[:m, None], 1)[:, 0]
    return out


def _labelled(model, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m["langs"], "und"], object)
        for batch in batches:
            where = batch.schema.names.index("text")
            flat, ends = code_points(batch.column(where).to_pylist())
            parts = []
            for i, j in passes(ends, _PASS):
                start, stop, doc, score = word_scores(m, flat[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                parts.append((start + ends[i], stop + ends[i], doc + i, score))
            start, stop, doc, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros((0, len(m["langs"]))),)
            lang = decode(score, np.searchsorted(doc, np.arange(len(batch) + 1)))
            share = np.zeros((len(batch), max(len(m["langs"]), 1)))
            if m["langs"]:
                np.add.at(share, (doc, lang), stop - start)
            total = share.sum(axis=1)
            top = np.where((total > 0) & bool(m["langs"]), share.argmax(axis=1), len(names) - 1)
            columns = [pa.array(names[top].tolist(), pa.string()), pa.array(np.where(total > 0, share.max(axis=1) / np.maximum(total, 1), 0.0))]
            added = ["lang_pred", "score"]
            if spans:
                cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])])) if len(doc) else np.zeros(0, np.int64)
                last = np.concatenate([cut[1:], [len(doc)]]) - 1 if len(cut) else cut
                found = [[] for _ in range(len(batch))]
                for a, b in zip(cut, last, strict=True):
                    d = doc[a]
                    found[d].append({"start": int(start[a] - ends[d]), "stop": int(stop[b] - ends[d]), "lang": names[lang[a]]})
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))))
                added.append("spans")
            yield pa.RecordBatch.from_arrays([*[c for k, c in enumerate(batch.columns) if k != where], *columns], [*[x for x in batch.schema.names if x != "text"], *added])

    return run


def identify(docs: DataFrame, learnable=None, keep: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """The `keep` columns of docs with lang_pred, score and, where asked for, spans of one language.

    Languages are those of the column lang in the rows that `learnable` (a condition) admits. Words are runs
    of letters of one script; each scores its letters' trigrams in the languages that are written in its
    script, and the best path over a document's words pays SWITCH for each change of language. lang_pred has
    most of the letters, score is its share of them; spans are (start, stop, lang) in code points. A text
    that is null or has no letter is `und` with score 0. Rows come back one for one; other columns aren't read.
    """
    model = learn(docs, F.lit(True) if learnable is None else learnable)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)], "text")
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    more = ", spans array<struct<start int, stop int, lang string>>" if spans else ""
    made = rows.mapInArrow(_labelled(shared, spans), f"{schema}lang_pred string, score double{more}")
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", *(["spans"] if spans else []))
