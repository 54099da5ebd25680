"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
keep the columns of ``documents``. Classifiers are fitted on labelled rows of
sf_dir's tables and decide on every row of docs. Rows with a null doc_id can't
be told apart by the near-duplicate stage and stay; rows that share a doc_id
are one document there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import quality, toxicity
from tesserae.llm.common import documents, map_batches, materialize, texts_of
from tesserae.llm.linededup import dedup_lines
from tesserae.llm.nearcopies import near_copies
from tesserae.llm.packing import pack_documents

#: Words of a shingle of the near-duplicate stage.
SHINGLE = 5
ORACLE_SQL = None


def _rows_where(docs: DataFrame, admit) -> DataFrame:
    """The rows whose texts ``admit`` (texts -> booleans), with all columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(admit(texts_of(batch.column(at))), pa.bool_()))

    return map_batches(docs, run, docs.schema)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier admits."""
    model = spark.sparkContext.broadcast(quality.train_quality(spark, sf_dir))
    return _rows_where(docs, lambda texts: list(model.value.scores(texts) >= quality.THRESHOLD))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    model = spark.sparkContext.broadcast(toxicity.train_toxicity(spark, sf_dir))
    return _rows_where(docs, lambda texts: [model.value.score(t) < toxicity.THRESHOLD for t in texts])


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one has."""
    found = dedup_lines(docs).select(docs.columns)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group: SimHash candidates and those by bands, linked by a shingle similarity of 0.8 or more."""
    firsts = near_copies(docs, SHINGLE).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(firsts, "doc_id", "left_semi").select(docs.columns).union(docs.where("doc_id is null"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("line dedup", unique_lines),
    ("simhash near-dedup", one_of_each),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next one reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
