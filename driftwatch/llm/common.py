"""Shared pieces of the corpus operators: the shared folder, stored tables and blocks of whole texts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that array code handles at once.
BLOCK_BYTES = 1 << 21


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of its own; on a cluster its absence is an error,
    as no folder of one machine can hold what other machines read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it outlives lost executors and cuts the lineage."""
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column; one row reaches the driver."""
    return int(docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0)


def shards_for(n_bytes: int, each: int) -> int:
    """How many shards keep each near ``each`` bytes of input; grows with the input without bound."""
    return max(4, -(-n_bytes // each))


def give_back() -> None:
    """Return freed memory to the system. Python workers live on after a task, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it keeps
        pass


def text_array(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets.astype(np.int64) - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES):
    """Slices of the batches with about ``limit`` bytes of text each (a longer text stands alone): batch, bytes, offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, cuts = text_array(batch.column(batch.schema.names.index(text)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(cuts, cuts[low] + limit, side="right")) - 1)
            yield batch.slice(low, high - low), data[cuts[low] : cuts[high]], cuts[low : high + 1] - cuts[low]
            low = high
