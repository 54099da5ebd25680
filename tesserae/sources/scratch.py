"""Folders for data that lives as long as a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import EngineError


def scratch(spark: SparkSession) -> str:
    """A new path below the cluster's checkpoint folder, which all machines share; a local one only where there is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/tesserae-{uuid.uuid4().hex}"
