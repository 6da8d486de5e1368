"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is not set, under a folder of this process in a local session, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="seatmetrics-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows is planned over files, and starts from them if an executor is lost."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
