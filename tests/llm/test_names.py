"""Columns of any name through the stages, the bound on languages, and what scopes leave behind."""

from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from gridloom.functions.shared import intermediates, shared_dir
from gridloom.llm import langid, quality, secrets, similar

SF = "/root/testdata/sf0.001"


def test_names_with_backticks_and_dots(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = docs.withColumn("back`tick", F.lit(1)).withColumn("a.b", F.lit("x")).withColumn("`", F.lit(2))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert quality.score_quality(odd, labels, keep=("doc_id", "back`tick", "a.b", "`")).columns == ["doc_id", "back`tick", "a.b", "`", "score", "predicted"]
    assert secrets.redact(odd).columns == odd.columns and secrets.redact(odd).count() == 60
    assert similar.drop_near_duplicates(odd).columns == odd.columns
    named = langid.identify(odd, keep=("doc_id", "back`tick", "a.b"))
    assert named.columns[:3] == ["doc_id", "back`tick", "a.b"] and named.count() == 60
    for _, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, odd, SF)
        assert made.columns == odd.columns and made.count() > 0


def test_the_languages_with_the_most_texts_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    most = [r.lang for r in docs.select("lang", "text").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2).collect()]
    assert {r.lang_pred for r in langid.identify(docs).select("lang_pred").distinct().collect()} <= {*most, "und"}


def test_the_pipeline_leaves_nothing_in_a_scope(spark):
    folder = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / "gridloom"
    before = set(folder.iterdir()) if folder.exists() else set()
    known = {t.name for t in spark.catalog.listTables()}
    with intermediates(spark):
        assert corpus_pipeline.run(spark, SF).count() > 0
    assert set(folder.iterdir()) == before
    assert {t.name for t in spark.catalog.listTables()} == known
