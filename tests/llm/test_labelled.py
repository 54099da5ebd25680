import pytest
from pyspark.sql import functions as F

from tesserae.llm import labelled


def test_a_text_that_does_not_fit_is_passed_over(spark, monkeypatch):
    ids = spark.range(8).select(F.col("id").alias("doc_id"))
    first = ids.orderBy(F.xxhash64("doc_id"), "doc_id").first()["doc_id"]
    docs = ids.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("long "), 100)).otherwise("short"))
    labels = ids.withColumn("toxic", (F.col("doc_id") == first).cast("int"))
    monkeypatch.setattr(labelled, "FIT_CHARS", 40)
    with pytest.warns(UserWarning, match="toxic: no text of label"):
        assert labelled.sample(docs, labels, "toxic", F.lit(True)) == (["short"] * 7, [0] * 7)
    monkeypatch.setattr(labelled, "FIT_CHARS", 10_000)
    assert len(labelled.sample(docs, labels, "toxic", F.lit(True))[0]) == 8
