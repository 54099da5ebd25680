import zlib

from pyspark.sql import functions as F

from tesserae.llm import sharding
from tesserae.llm.catalog import LLM_QUERIES
from tesserae.llm.common import documents


def check(rows, shards):
    by = {}
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    return by


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = LLM_QUERIES["op10_histogram_shards"](spark, sf).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents(spark, sf).collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
    sizes = [sum(r["size"] for r in part) for part in check(rows, 8).values()]
    largest = max(r["size"] for r in rows)
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * largest
    where = {}
    for r in rows:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_hot_group_is_divided(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    rows = sharding.shard_documents(df, 4).collect()
    sizes = [sum(len(r["text"]) + 1 for r in part) for part in check(rows, 4).values()]
    assert len(sizes) == 4 and max(sizes) <= 1.02 * min(sizes)


def test_corners(spark, docs, none):
    rows = sharding.shard_documents(docs, 8).collect()
    assert len(rows) == docs.count()  # docs has a column named shard: it gives way to the result's
    check(rows, 8)
    assert sharding.shard_documents(none, 8).collect() == []
    assert len(check(sharding.shard_documents(docs, 1).collect(), 1)) == 1


def test_no_python_in_the_plan(spark, sf):
    plan = LLM_QUERIES["op10_histogram_shards"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_the_query_exchanges_whole_texts(spark, sf):
    plan = LLM_QUERIES["op10_histogram_shards"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    window = next(k for k, line in enumerate(plan) if "Window" in line and "row_number" in line)
    assert any("crc32(" in line for line in plan[:window]) and not any("crc32(" in line for line in plan[window:])
