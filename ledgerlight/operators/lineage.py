"""Frames that are used several times and dear to make."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; only a local master without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ledgerlight-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/ledgerlight-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows, made once: written to the shared folder and read again, which also cuts the lineage."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
