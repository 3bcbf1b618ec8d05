"""Small files that publish what a job has written: whole or not at all, on any file system that Spark reaches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class AlreadyPublished(RuntimeError):
    """Another writer has published under this name."""


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, found = _path(spark, path)
    return fs.exists(found)


def names(spark: SparkSession, folder: str, pattern: str = "*.json") -> list[str]:
    """File names of a folder that match, sorted; none if the folder is absent."""
    fs, found = _path(spark, f"{folder}/{pattern}")
    return sorted(s.getPath().getName() for s in fs.globStatus(found) or [])


def files(spark: SparkSession, pattern: str) -> list[str]:
    """Full paths that match a pattern, sorted."""
    fs, found = _path(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(found) or [])


def load(spark: SparkSession, path: str) -> dict:
    fs, found = _path(spark, path)
    stream = fs.open(found)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, content: dict) -> None:
    """Write aside and rename, so a reader sees the whole content or no file. Raises ``AlreadyPublished`` if it is there."""
    fs, target = _path(spark, path)
    _, aside = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(json.dumps(content).encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise AlreadyPublished(path)
