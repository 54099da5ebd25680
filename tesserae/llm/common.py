"""Helpers that the training-data operators share.

Intermediate tables are written as Parquet below the folder that the cluster
names in ``spark.checkpoint.dir``: that cuts lineage with files which every
executor can read, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 2048
BATCH_BYTES = 8 << 20


def _own_folder(spark: SparkSession, root: str) -> str:
    return f"{root.rstrip('/')}/tesserae/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new path below the shared checkpoint folder; a local one is set only where none is and there is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="tesserae-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{_own_folder(spark, root)}/{tag}-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Remove this application's tables in between below the shared folder; for the end of a job, when no result is still to be read."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark, root))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, keeps columns prunable."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts; smaller settings are kept."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).lower()
        if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > most:
            spark.conf.set(name, str(most))


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow over bounded batches; fn takes and gives an iterator of record batches. Workers outlive tasks, so each gives back what it held."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """A string column's values; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def spare_prefix(df: DataFrame, prefix: str) -> str:
    """The prefix, lengthened until no column's name begins with it, for columns that only live inside an operator."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def give_back() -> None:
    """Return memory that Arrow and the C library keep of freed arrays, where they can be told to; after a task or a fit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: A key is hot if its rows exceed this part of a shuffle partition's even share.
HOT_SHARE = 1 / 8


def join_skewed(left: DataFrame, right: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join on keys that are unique in right, whose column n counts left's rows of each.

    Hot keys are joined by broadcast where left's rows are; there are fewer
    than partitions / HOT_SHARE of them, whatever the data. The rest is
    shuffled. right is read several times: give a written table.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    most = HOT_SHARE * total / shuffle_width(left.sparkSession)
    hot = F.broadcast(right.where(F.col(n) > most))
    rest = left.join(hot.select(keys), keys, "left_anti").join(right.where(F.col(n) <= most), keys)
    return left.join(hot, keys).unionByName(rest)
