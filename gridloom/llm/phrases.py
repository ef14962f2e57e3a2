"""Collocations: phrases counted by suffix automata of shards, reduced over all, scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.ranks import running
from gridloom.llm.common import arrow_batches, mix64, passes, utf8, written

#: Bytes of text in one automaton; a longer document has one of its own.
SHARD_BYTES = 8 << 20
#: Bits of a filter of frequent phrases, at most: 16 MB.
FILTER_BITS = 1 << 27
#: Shares that a language's phrases are ranked in before they are ranked together.
SHARES = 64
#: Rows of an Arrow batch of counts.
ROWS = 1 << 16
#: What a byte is: 0 part of a word, 1 space between words, 2 end of a piece. Fixed values of the contract.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def tokens(flat: np.ndarray, ends: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of texts in a row, each word's text, and its place in its piece from 0; nothing crosses the end of a text."""
    flat = _LOWER[flat]
    kind = KIND[flat]
    inside = kind == 0
    edge = np.zeros(len(flat) + 1, bool)
    edge[ends] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(flat[inside])).dictionary_encode()
    text = np.searchsorted(ends, start, "right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == 2), start)
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(piece) != 0)
    at = np.arange(len(start))
    return words, text, at - np.maximum.accumulate(np.where(new, at, 0))


def automaton(words: np.ndarray, sort: np.ndarray, place: np.ndarray, depth: int, ends: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length up to `depth` the strings of words of that length: the place of one end of each, and how many ends there are.

    words are numbers, sort tells languages apart, place is a word's position in its piece. The strings are the nodes of the tree of suffix links of
    the generalised suffix automaton of all pieces, cut at `depth`: a string's link is the string without its first word,
    so the nodes of a level part those of the level before by one more word to the left, and a node's count is the size of its set of ends
    (endpos). Strings with the same ends are one state of the automaton; enumerating its strings gives each its own count.
    ends: only strings that end there, which all must have `depth` words of their piece.
    """
    if not len(words):
        return
    _, word = np.unique(sort.astype(np.int64) * (int(words.max()) + 1) + words, return_inverse=True)
    ends, base = np.arange(len(words)) if ends is None else ends, int(word.max()) + 1
    state = word[ends].astype(np.int64)
    for size in range(1, depth + 1):
        if size > 1:
            long = place[ends] >= size - 1
            ends, state = ends[long], state[long]
            state = state * base + word[ends - size + 1]
        order = np.argsort(state)
        key = state[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        yield size, ends[order[first]], np.diff(np.append(first, len(key)))
        state[order] = np.cumsum(new) - 1


# which strings can be frequent


def _hashes(texts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t.encode()) for t in texts], np.uint64)


def _joined(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """A hash of a language and words in order, from theirs."""
    out = lang
    for w in words:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + w)
    return out


def _bits(key: np.ndarray, size: int) -> list[np.ndarray]:
    other = mix64(key)
    return [(x >> np.uint64(s)) & np.uint64(size - 1) for x in (key, other) for s in (0, 32)]


def _holds(filter_: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a key may be among those of the filter; it is never denied to one that is."""
    found = np.ones(len(key), bool)
    for at in _bits(key, 64 * len(filter_)):
        found &= filter_[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) > 0
    return found


def bloom(known: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of the table's phrases of `size` words, in 64-bit words: 16 bits a phrase, and FILTER_BITS at most."""
    some = known.where(F.col("words") == size).select("lang", "phrase")
    n = 1 << int(min(max(16 * some.count(), 1 << 10), FILTER_BITS) - 1).bit_length()

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(n // 64, np.uint64)
        for batch in batches:
            words = _hashes([w for p in batch.column(1).to_pylist() for w in p.split(" ")]).reshape(-1, size)
            for at in _bits(_joined(_hashes(batch.column(0).to_pylist()), list(words.T)), n):
                np.bitwise_or.at(own, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at].view(np.int64))], ["at", "bits"])

    met = some.mapInArrow(marked, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(n // 64, np.uint64)
    out[met.column("at").to_numpy()] = met.column("bits").to_numpy().view(np.uint64)
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(lang, text) of runs of whole documents of SHARD_BYTES together, or of one longer document."""
    held, size = [], 0
    for batch in batches:
        lang, text = batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string())
        _, ends = utf8(text)
        for i, j in passes(ends, SHARD_BYTES):
            n = int(ends[j] - ends[i])
            if held and size + n > SHARD_BYTES:
                yield tuple(pa.concat_arrays(x) for x in zip(*held, strict=True))
                held, size = [], 0
            held.append((lang.slice(i, j - i), text.slice(i, j - i)))
            size += n
    if held:
        yield tuple(pa.concat_arrays(x) for x in zip(*held, strict=True))


def _counted(least: int, depth: int, shared=None):
    """Batches of (lang, text) to (lang, phrase, f): the strings of `least` to `depth` words of a shard, and, from one word on, under "" how many words it has.

    shared: a Bloom filter of frequent strings of a word less; of others none longer is frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _shards(batches):
            langs = lang.dictionary_encode()
            words, doc, place = tokens(*utf8(text))
            number, sort = words.indices.to_numpy(), langs.indices.to_numpy()[doc]
            if least == 1:
                total = np.bincount(sort, minlength=len(langs.dictionary)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([langs.dictionary, pa.array([""] * len(total)), pa.array(total)], ["lang", "phrase", "f"])
            ends = None
            if shared is not None:
                ends = np.flatnonzero(place >= depth - 1)
                own, tongue = _hashes(words.dictionary.to_pylist()), _hashes(langs.dictionary.to_pylist())
                part = np.flatnonzero(place >= depth - 2)
                may = np.zeros(len(place), bool)
                may[part] = _holds(shared.value, _joined(tongue[sort[part]], [own[number[part - k]] for k in range(depth - 2, -1, -1)]))
                # the string's suffix link ends where it does, the string without its last word a word before
                ends = ends[may[ends] & may[ends - 1]]
            for size, end, n in automaton(number, sort, place, depth, ends):
                for i in range(0, len(end) if size >= least else 0, ROWS):
                    e = end[i : i + ROWS]
                    parts = [words.dictionary.take(pa.array(number[e - k])) for k in range(size - 1, -1, -1)]
                    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(sort[e])), phrase.cast(pa.string()), pa.array(n[i : i + ROWS], pa.int64())], ["lang", "phrase", "f"])

    return run


def frequencies(docs: DataFrame, most: int = 3, least: int = 10, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, words, f: all phrases of 1 to `most` words that occur `least` times or more, and under "" (words 0) each language's number of words.

    Words and pairs are counted first. Longer phrases are grown a word at a time: one is frequent only if its suffix link and what
    is left without its last word are, which a filter of the frequent ones tells each shard. The filter errs only by counting
    more, and where a corpus has more frequent phrases than it is sized for, all are counted.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def reduced(task) -> DataFrame:
        # a shard has counted its own phrases, so they meet without another look for equal ones before the shuffle
        total = read.mapInArrow(task, "lang string, phrase string, f long").repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ", -1)))
        return written(total.where((F.col("f") >= least) | (F.col("phrase") == "")).select("lang", "phrase", size.alias("words"), "f"))

    known = reduced(_counted(1, min(most, 2)))
    for size in range(3, most + 1):
        known = known.unionByName(reduced(_counted(size, size, spark.sparkContext.broadcast(bloom(known, size - 1)))))
    return known


def _part(words: str, first, size):
    return F.array_join(F.slice(F.col(words), first, size), " ")


def collocations(docs: DataFrame, most: int = 3, least: int = 10, cover: int = 50, top: int | None = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of 2 to `most` words by the score of their weakest cut.

    Words are what space and tab part in the pieces between `.,;:!?` and line ends; only A-Z changes case. f counts all
    occurrences within pieces, n all words. A phrase with a = f >= least is a candidate; its cut after k words scores
    floor(1000000 a a / (l r)), exact in decimals; the lowest cut counts, of equal ones the first. A candidate goes if it lies
    in a longer candidate with 100 f >= cover a: longer ones hand their count down their suffix links (without the first word) and
    to what is left without the last, length by length, so each phrase gets the largest count of those around it. The
    first `top` of a language stay (None: all), by score, a, and phrase in byte order.

    Null texts are empty, a null lang is `und`; repeated rows and ids count as often as they are there. Empty tables and languages
    without candidates give no rows. Long texts are whole: one beyond a shard's bytes is a shard of its own. Other columns are not read.
    """
    known = frequencies(docs, most, least, text, lang)
    found = known.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("w"))
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("w", F.lit(1), F.col("k")).alias("left"), _part("w", F.col("k") + 1, F.size("w")).alias("right"))
    side = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    a, l, r = (F.col(c).cast("decimal(18,0)") for c in "alr")
    cuts = cuts.withColumns({"up": F.lit(1000000).cast("decimal(7,0)") * a * a, "down": l * r}).withColumn("score", F.expr("up div down"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # what holds a phrase, from the longest down: a longer phrase's own count and what holds it
    longer, over = None, found.select("lang", "w", "words", "a")
    for size in range(most, 2, -1):
        now = over.where(F.col("words") == size).select("lang", "w", F.col("a").alias("f"))
        now = now if longer is None else now.unionByName(longer)
        sides = F.explode(F.array(F.slice("w", 2, size - 1), F.slice("w", 1, size - 1)))
        longer = now.select("lang", sides.alias("w"), "f").groupBy("lang", "w").agg(F.max("f").alias("f"))
        each = longer.select("lang", F.array_join("w", " ").alias("phrase"), "f")
        held = each if size == most else held.unionByName(each)
    if most > 2:
        scored = scored.join(held, ["lang", "phrase"], "left").where(F.col("f").isNull() | (F.col("f") * 100 < F.col("a") * cover))
    n = known.where("words = 0").select("lang", F.col("f").alias("n"))
    order = [F.desc("cut.score"), F.desc("a"), F.col("phrase")]
    if top is None:
        placed = running(scored, [F.col("lang"), *order])
        first = placed.groupBy("lang").agg(F.min("place").alias("first"))
        ranked = placed.join(first, "lang").withColumn("rank", F.col("place") - F.col("first") + 1)
    else:
        # the best of each of a few shares of a language first, so that its last task gets so many times `top` phrases at most
        ranked = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
        for keys in (["lang", "share"], ["lang"]):
            ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))


SQL = r"""
with p as (select coalesce(lang, 'und') lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
w as (select lang, row_number() over () p, regexp_extract_all(piece, '[^\x20\x09]+') w from p),
u as (select lang, p, unnest(w) x, generate_subscripts(w, 1) i from w),
n3 as (select lang, x, lead(x, 1) over (partition by p order by i) y, lead(x, 2) over (partition by p order by i) z from u),
g as (select lang, 1 words, x phrase from n3 union all select lang, 2, x || ' ' || y from n3 where y is not null union all select lang, 3, x || ' ' || y || ' ' || z from n3 where z is not null),
f as (select lang, words, phrase, count(*) f from g group by all),
total as (select lang, sum(f) n from f where words = 1 group by lang),
c as (select lang, words, phrase, f a, string_split(phrase, ' ') w from f where words > 1 and f >= 10),
cut as (select c.*, k.k k, array_to_string(w[1:k.k], ' ') lw, array_to_string(w[k.k + 1:], ' ') rw from c, range(1, 3) k(k) where k.k < words),
scored as (select cut.lang, cut.phrase, cut.words, a, k, l.f l, r.f r, cast(1000000::hugeint * a * a // (l.f::hugeint * r.f) as bigint) score
  from cut join f l on l.lang = cut.lang and l.phrase = lw join f r on r.lang = cut.lang and r.phrase = rw),
best as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) o from scored) where o = 1),
inside as (select lang, array_to_string(w[1:2], ' ') phrase, a f from c where words = 3 union all select lang, array_to_string(w[2:3], ' '), a from c where words = 3),
held as (select lang, phrase, max(f) f from inside group by all),
ranked as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) rank
  from best b left join held h on h.lang = b.lang and h.phrase = b.phrase where b.words > 2 or h.f is null or 100 * h.f < 50 * a)
select ranked.lang, rank, phrase, a, l, r, cast(n as bigint) n, score from ranked join total on total.lang = ranked.lang where rank <= 2000
"""
