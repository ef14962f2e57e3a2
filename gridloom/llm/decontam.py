"""Benchmark passages in documents: a prefix-filtered join of windows, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of the corpus, in lower case and as they are. Letters are listed one by one: Java looks those up in a table of
#: bits and tests ranges, the more so the negated, one after another, at over ten times the cost.
WORD = rf"[{LOWER}0123456789\x80-\x{{10FFFF}}]+"
ANY_WORD = rf"[{UPPER}{LOWER}0123456789\x80-\x{{10FFFF}}]+"
#: Benchmark words up to which the windows are sent to all tasks; beyond, documents' shingles are shuffled.
BROADCAST_WORDS = 500_000


def words(text: Column) -> Column:
    """The words of a text in order; none for null. Only A-Z changes case."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.regexp_extract_all(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), F.lit(WORD), F.lit(0))


def _shingle(array: str, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col(array), at + k) for k in range(size)])


def windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, win (words): `window` consecutive words of each item, or all of an item of fewer but some."""
    w = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    return w.select("item_id", "words", F.explode(starts).alias("s")).select("item_id", F.slice("words", F.col("s") + 1, window).alias("win"))


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """doc_id, same (a hash of the text), start, length, item_id of each place where a document holds a window.

    A document holds a window only if it holds all its shingles, so one of them is a sufficient prefix:
    the rarest over all documents. The documents' shingles meet those tokens in a hash join; a candidate's
    place in the document must leave room for the window on both sides, and its words must be the window's.
    Shingles are cut shorter where the benchmark has an item of fewer words.
    """
    spark = docs.sparkSession
    win = windows(items, window)
    known = win.agg(F.min(F.size("win")).alias("least"), F.sum(F.size("win")).alias("words")).first()
    if known["least"] is None:
        empty = "doc_id long, same long, start int, length int, item_id long"
        return spark.createDataFrame([], empty)
    size = min(shingle, known["least"])
    small = known["words"] <= BROADCAST_WORDS * window
    side = F.broadcast if small else (lambda df: df)
    at = F.col("at")
    parts = win.select("item_id", "win", F.explode(F.sequence(F.lit(0), F.size("win") - size)).alias("at")).withColumn("token", _shingle("win", at, size))
    # how often each of the windows' shingles is in all documents
    placed = docs.select("doc_id", F.xxhash64("text").alias("same"), words(F.col("text")).alias("words"))
    # the outer form keeps the optimizer from asking for words twice, to drop texts without any first
    exploded = placed.select("doc_id", "same", "words", F.posexplode_outer("words").alias("p", "word"))
    exploded = exploded.where(F.col("p") <= F.size("words") - size)
    seen = exploded.select(_shingle("words", F.col("p"), size).alias("token"))
    counted = seen.join(side(parts.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    # tokens that no document holds rule their window out
    ranked = parts.join(counted, "token", "left").groupBy("item_id", "win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"), F.col("at"))).alias("rarest"))
    prefix = ranked.where("rarest.n > 0").select(F.col("rarest.token").alias("token"), F.col("rarest.at").alias("at"), "item_id", "win")
    prefix = prefix.checkpoint() if small else prefix
    start = F.col("p") - F.col("at")
    here = exploded.withColumn("token", _shingle("words", F.col("p"), size)).withColumn("n", F.size("words")).withColumn("from", F.lit(0))
    if not small:
        # rows that are shuffled carry the words that a window there could reach, not all of the text's
        here = here.withColumn("from", F.greatest(F.col("p") - (window - 1), F.lit(0)))
        here = here.withColumn("words", F.slice("words", F.col("from") + 1, 2 * window))
    met = here.select("doc_id", "same", "words", "p", "n", "from", "token").join(side(prefix), "token")
    met = met.where((start >= 0) & (start + F.size("win") <= F.col("n")))
    met = met.where(F.slice("words", start - F.col("from") + 1, F.size("win")) == F.col("win"))
    return met.select("doc_id", "same", start.alias("start"), F.size("win").alias("length"), "item_id")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and same (a hash of the text) of each row of docs.

    n_hit counts the words inside any occurrence of a window of `window` consecutive item words (all words of
    a shorter item), n_items the items with occurring windows, items_sha256 is of their ids, sorted as
    strings, comma-joined. Null and empty texts have no words; without items nothing is contaminated. Rows
    come back one for one, repeated ones too; an item_id of several rows is one item; a null item_id counts
    for its hits but is no item. Other columns are not read.
    """
    found = occurrences(docs, items, window, shingle)
    spans = F.collect_set(F.struct("start", "length"))
    place = F.flatten(F.transform(spans, lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1)))
    hits = found.groupBy("doc_id", "same").agg(
        F.size(F.array_distinct(place)).cast("long").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids")
    )
    text = F.col("text")
    base = docs.select("doc_id", F.xxhash64("text").alias("same"), F.coalesce(F.regexp_count(text, F.lit(ANY_WORD)), F.lit(0)).cast("long").alias("n_words"))
    hits = hits.select(F.col("doc_id").alias("id"), F.col("same").alias("hash"), "n_hit", "ids")
    joined = base.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("same") == F.col("hash")), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", n.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"), "same"
    )


SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item_id, s.s s, least(len(w), 10) n, array_to_string(w[s.s:s.s + least(len(w), 10) - 1], ' ') g from iw, unnest(range(1, greatest(len(w) - 10, 0) + 2)) s(s) where len(w) > 0),
sizes as (select distinct n from win),
pos as (select doc_id, n, p.p p, array_to_string(w[p.p:p.p + n - 1], ' ') g from dw, sizes, unnest(range(1, len(w) - n + 2)) p(p) where len(w) >= n),
hit as (select doc_id, p, pos.n n, item_id from pos join win on pos.n = win.n and pos.g = win.g),
covered as (select doc_id, count(distinct q.q) n_hit from (select distinct doc_id, p, n from hit) h, unnest(range(p, p + n)) q(q) group by doc_id),
found as (select doc_id, count(*) n_items, sha256(string_agg(i, ',' order by i)) s from (select distinct doc_id, cast(item_id as varchar) i from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(c.n_hit, 0) as bigint) n_hit, cast(coalesce(f.n_items, 0) as bigint) n_items,
  coalesce(f.s, sha256('')) items_sha256, coalesce(c.n_hit, 0) > 0 contaminated
from dw d left join covered c using (doc_id) left join found f using (doc_id)
"""
