"""Exact duplicates by a content sort, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import fresh, quoted, written
from gridloom.llm.decontam import LOWER, UPPER

#: Code points of a text that a splitter of the ranges holds; a hash of the whole text follows, so ranges part below a common beginning.
PREFIX = 48
#: A group of copies is dealt to slices if it has one row of this many; there are no more such groups than this.
HOT_SHARE = 10_000


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row: which row stays of those with an equal normalised text.

    Rows are dealt to ranges of (beginning, hash, slice) by sampled splitters and sorted inside them by that and
    the whole text, so equal texts are neighbours; only comparisons of whole neighbouring texts make a group, the hash does
    not. A group that has more than a row in HOT_SHARE is cut into as many slices as the root of its size, by a hash of its ids: each slice
    finds its own first row, and the slices' first rows, again a root of them, are sorted and compared once more. So no task gets
    a group whole, and texts are shuffled once. The hot groups' hashes, HOT_SHARE at most, are the only thing broadcast.

    keep: `smallest` or `largest` id. A null text equals an empty one. A null id loses against any other; among rows of one
    id and one text any one stays, the others go, and keep_id is their id. Rows come back one for one, an empty table
    gives an empty one. Other columns are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    rows = docs.select(F.col(quoted(id_)).alias("id"), normalised(F.col(quoted(text))).alias("norm")).withColumn("hash", F.xxhash64("norm"))
    copies = rows.groupBy("hash").agg(F.count("*").alias("n"))
    least = max(1000, docs.count() // HOT_SHARE)
    hot = copies.where(F.col("n") > least).select("hash", F.ceil(F.sqrt("n")).alias("slices"))
    rows = rows.join(F.broadcast(hot), "hash", "left")
    rows = rows.withColumn("slice", F.when(F.col("slices").isNotNull(), F.pmod(F.xxhash64("id"), "slices") + 1).otherwise(0)).withColumn("begin", F.substring("norm", 1, PREFIX))
    first = F.desc_nulls_last if keep == "largest" else F.asc_nulls_last
    ranges = ["begin", "hash", "slice"]
    dealt = rows.select("id", "norm", *ranges).repartitionByRange(*ranges).sortWithinPartitions(*ranges, "norm", first("id"))
    same = Window.partitionBy(*ranges, "norm").orderBy(first("id"))
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    grouped = dealt.select(
        "id", "hash", "slice", "begin", F.sha2("norm", 256).alias("text_sha256"), F.row_number().over(same).alias("place"), F.first("id").over(whole).alias("best"), F.count("*").over(whole).alias("n"),
        F.dense_rank().over(Window.partitionBy(*ranges).orderBy("norm")).alias("form"), F.when(F.col("slice") > 0, F.col("norm")).alias("norm"),
    )
    # the text goes on only with the first row of each slice of a hot group
    grouped = written(grouped.withColumn("norm", F.when(F.col("place") == 1, F.col("norm"))))
    cold = grouped.where("slice = 0").select("id", F.col("best").alias("keep"), F.col("n").alias("size"), (F.col("place") == 1).alias("stays"), "text_sha256")
    heads = grouped.where("slice > 0 and place = 1").select("begin", "hash", "slice", "form", "norm", "best", "n")
    heads = heads.repartitionByRange("begin", "hash").sortWithinPartitions("begin", "hash", "norm", first("best"), "slice")
    same = Window.partitionBy("begin", "hash", "norm").orderBy(first("best"), "slice")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    joined = heads.select("begin", "hash", "slice", "form", F.first("best").over(whole).alias("keep"), F.sum("n").over(whole).alias("size"), (F.row_number().over(same) == 1).alias("wins"))
    spread = grouped.where("slice > 0").select("id", "begin", "hash", "slice", "form", "place", "text_sha256").join(joined, ["begin", "hash", "slice", "form"])
    spread = spread.select("id", "keep", "size", (F.col("wins") & (F.col("place") == 1)).alias("stays"), "text_sha256")
    return cold.unionByName(spread).select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("stays").alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that `exact_duplicates` keeps, with all their columns whatever they are called.

    Rows that share an id and a text leave one: which of them is not said where their other columns differ. Ids of
    rows with different texts are told apart by the text's digest.
    """
    names = docs.columns
    digest, kept_digest, of = fresh(names, "digest", "kept_digest", "of")
    kept = exact_duplicates(docs, id_, text, keep).where("kept").select(F.col("doc_id").alias(of), F.col("text_sha256").alias(kept_digest))
    own = docs.withColumn(digest, F.sha2(normalised(F.col(quoted(text))), 256))
    own = own.join(kept, F.col(quoted(id_)).eqNullSafe(F.col(of)) & (F.col(digest) == F.col(kept_digest)), "left_semi")
    return own.dropDuplicates([digest, id_]).select(*[quoted(c) for c in names])


SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') norm from documents)
select doc_id, max(doc_id) over (partition by norm) keep_id, count(*) over (partition by norm) group_size,
  row_number() over (partition by norm order by doc_id desc) = 1 kept, sha256(norm) text_sha256
from t
"""
