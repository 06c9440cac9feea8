"""Incremental runs (survey T1-T5): the fetch log as a stream, state as Parquet snapshots."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.store import latest
from ..sources.readers import MANIFEST


def manifest_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """New log files as they appear."""
    return spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", files_at_once).option("mode", "DROPMALFORMED").json(path)


def new_urls(stream: DataFrame) -> DataFrame:
    """The first saved entry of each URL; known URLs are the stream's state."""
    return stream.filter(F.col("status").isin("fetched", "saved")).dropDuplicates(["url"])


class Snapshots:
    """A table of numbered snapshots; a batch that is run again gives the same snapshot."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def _numbers(self) -> list[int]:
        fs = self.spark._jvm.org.apache.hadoop.fs
        root = fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        found = [s.getPath() for s in files.listStatus(root)]
        return sorted(int(p.getName().removeprefix("v")) for p in found if p.getName().startswith("v") and files.exists(fs.Path(p, "_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        some = [n for n in self._numbers() if before is None or n < before]
        if not some:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(os.path.join(self.path, f"v{some[-1]}"))

    def write(self, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(os.path.join(self.path, f"v{number}"))


def merge_into(snapshots: Snapshots, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """T4: a foreachBatch function that merges each batch into the state before it."""

    def run(batch: DataFrame, number: int) -> None:
        snapshots.write(merge(snapshots.read(number), batch), number)

    return run


def latest_status(spark: SparkSession, manifest: str, state: str, checkpoint: str, files_at_once: int = 100):
    """Runs until all log files are taken in; the state holds each URL's last entry by status order."""
    snapshots = Snapshots(spark, state, MANIFEST)
    order = (F.desc("meeting_date"), F.desc("status"), F.to_json(F.struct("*")))
    merge = merge_into(snapshots, lambda old, new: latest(old.unionByName(new), "url", *order))
    query = manifest_stream(spark, manifest, files_at_once).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return snapshots


def live(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, minutes: float | None = None):
    """Once over what is there, or on and on every so many minutes (one second at least)."""
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if minutes is None else writer.trigger(processingTime=f"{max(int(minutes * 60), 1)} seconds")).start()


class Progress(StreamingQueryListener):
    """T5: rows taken in so far, told every `stride` rows."""

    def __init__(self, stride: int, tell: Callable[[int], None]):
        self.stride, self.tell, self.rows, self.told = stride, tell, 0, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        if self.rows - self.told >= self.stride:
            self.told = self.rows
            self.tell(self.rows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
