"""Repeated labelled ids: what is fitted has one row for each id."""

from pyspark.sql import functions as F

from casewright.llm import site_quality, toxicity
from tests.conftest import SF


def test_repeats_of_a_labelled_id_do_not_reach_the_fit(spark, tmp_path):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    once = toxicity.fit(docs, labels)
    hot = labels.where("toxic = 1").agg(F.min("doc_id")).first()[0]
    path = str(tmp_path / "docs")
    docs.withColumn("k", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") == hot, 500).otherwise(1)))).drop("k").write.parquet(path)
    many = spark.read.parquet(path)
    again = toxicity.fit(many, labels)
    assert again.weights == once.weights and again.bias == once.bias
    parts = {r.doc_id: r.text_score for r in site_quality.score(docs, labels).collect()}
    more = site_quality.score(many, labels).select("doc_id", "text_score").distinct().collect()
    assert {r.doc_id: r.text_score for r in more} == parts
