"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chunking, codes, ctph, decontam, exact, langid, mixing, phrases, quality, secrets, simhash, suffix, warc
from gridloom.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score_quality(docs, labels, quality.fold("doc_id", 3) != 1)
    return scored.select("doc_id", (quality.fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"), quality.fold("doc_id", 5) != 0)
    return found.select("doc_id", (quality.fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.edit_likeness(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.remove_chunks(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("same")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op6_mixing": op6_mixing,
    "op9_decontamination": op9_decontamination,
    "op10_secrets": op10_secrets,
    "op1_warc": op1_warc,
    "op4_ctph": op4_ctph,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op5_simhash": op5_simhash,
    "op8_chunk_dedup": op8_chunk_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_collocations": op13_collocations,
}
SQL: dict[str, str] = {
    "op9_decontamination": decontam.SQL,
    "op10_secrets": secrets.SQL,
    "op11_vector_codes": codes.SQL,
    "op12_exact_dedup": exact.SQL,
    "op13_collocations": phrases.SQL,
}
