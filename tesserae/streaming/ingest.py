"""Streams of documents into a managed collection.

Every micro-batch is one merge by id, committed by the store's atomic switch;
a batch that runs again after a failure merges the same documents again, so
the collection ends up the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def ingest(engine: Engine, stream: DataFrame, name: str, checkpoint: str, order: str | None = None, once: bool = True) -> StreamingQuery:
    """Merge a stream with a string column id into a collection; of an id's rows in a batch the last by ``order`` counts."""

    def batch(df: DataFrame, _: int) -> None:
        if order is not None:
            last = Window.partitionBy("id").orderBy(F.desc(order))
            df = df.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
        else:
            df = df.dropDuplicates(["id"])
        engine.merge(name, df)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
