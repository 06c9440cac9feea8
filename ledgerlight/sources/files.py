"""Folders and files of any file system that the session can reach, through Hadoop's file system classes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place) and system.getFileStatus(place).isDirectory()


def listed(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Sorted names in a folder, and whether each is a folder."""
    system, place = _at(spark, path)
    return sorted((s.getPath().getName(), s.isDirectory()) for s in system.listStatus(place))


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    system, place = _at(spark, path)
    return system.getContentSummary(place).getLength() if system.exists(place) else 0


def child(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def write(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file from the driver."""
    system, place = _at(spark, path)
    out = system.create(place, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
