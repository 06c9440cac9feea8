"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; only a local master without that setting gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ledgerlight-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/ledgerlight-{uuid.uuid4().hex}"


@contextlib.contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Within it, the engine removes an execution's shuffle files as soon as the execution has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again, which cuts the lineage and frees the shuffle files."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    with releasing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if _MADE:
        _MADE[-1].append(out)
    return out


#: Tables written since each `lasting` that is under way began.
_MADE: list[list[DataFrame]] = []


def lasting(make: Callable[[], DataFrame]) -> DataFrame:
    """The rows that `make` gives, written; the tables that were written on the way are deleted."""
    _MADE.append([])
    try:
        out = written(make())
    finally:
        made = _MADE.pop()
    drop(*made[:-1])
    if _MADE:
        _MADE[-1].append(out)
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes tables that `written` made and that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_written_at", None):
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
