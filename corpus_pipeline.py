"""A training corpus from `documents`: the stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.shared import delete, intermediates, scratch
from gridloom.llm import decontam, mixing, quality, secrets, similar
from gridloom.llm.common import fresh, quoted, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their nearest labelled neighbours don't reject.

    Null and empty texts have no neighbours and go with the share of good texts in the sample. Rows are judged one by
    one: repeated rows and rows of one doc_id with different texts, null ids too, each have their text's score; a score
    of 0.5 stays. Labels without a document are not learnt from. Without any usable label every score is 0.5, so
    everything stays. An empty table gives an empty one. All columns come back as they were, whatever they are called.
    """
    names = tuple(docs.columns)
    score, predicted = fresh(names, "score", "predicted")
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), quality.fold("doc_id", 3) != 1, names, (score, predicted))
    return scored.where(F.col(predicted) == 1).select(*[quoted(c) for c in names])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike to 0.8 or more, linked over others too.

    Of a group the smallest doc_id stays (null is smaller than any), of several texts with that id the one of least
    hash, and of rows that repeat both, one. Null, empty and blank texts are one group. An empty table gives an
    empty one. All columns come back as they were, whatever they are called.
    """
    return similar.drop_near_duplicates(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark: no ten consecutive words of an item, and no whole shorter item.

    Null and empty texts have no words and stay; so does everything if the benchmark is empty. A row is told by doc_id and
    text, so of rows that share an id, null ids too, only those with a passage go, and repeated rows go or stay together. An
    empty table gives an empty one. All columns come back as they were, whatever they are called.
    """
    id_, same = fresh(docs.columns, "leaked_id", "leaked_same")
    found = decontam.occurrences(docs, table(spark, sf_dir, "benchmark"))
    gone = found.select(F.col("doc_id").alias(id_), F.col("same").alias(same)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(same)), "left_anti")


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their live-looking secrets masked; no document goes.

    Null and empty texts, and texts without such spans, stay as they are. A row is told by doc_id and text, so rows that share
    an id are masked each for itself, and repeated rows alike. A null source is one owner. n_chars follows
    a masked text. An empty table gives an empty one. The columns come back in their order, whatever they are called.
    """
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture's epochs take of each source: doc_id, source, n_tokens, copy, block_rank, place.

    Null and empty texts count one token, a null source is a source of its own, null and repeated doc_ids are dealt
    by their texts too, repeated rows count and come back each. An empty table gives an empty one. Other columns are not read.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_redaction),
    ("mixing sources to target weights", mixture),
]
#: Learned models and hashes of texts are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over `documents`, each written and read again; what a stage needed is deleted once it is written."""
    docs, read = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = scratch(spark)
        with intermediates(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if read is not None:
            delete(spark, read)
        docs, read = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
