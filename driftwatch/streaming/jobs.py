"""Streaming counterparts of the batch operators, and sinks that can be replayed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from driftwatch.operators.alerts import suppression_micros
from driftwatch.sources import manifest
from driftwatch.streaming.state import BUCKET_MS, ChangePattern, Ordered, Predecessor, Suppression

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATERMARK = "10 minutes"
#: An event time after all others; a row with it closes a finite stream.
CLOSING = "9000-01-01 00:00:00"


def use_rocksdb(spark: SparkSession) -> None:
    """State with typed variables needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_files(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int = 1
) -> DataFrame:
    """A stream of the parquet files in a folder, oldest first."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


class Closing:
    """The end of a finite stream: a second source that stays empty until ``close``.

    Rows within the watermark's delay of the newest one wait for later rows. A stream that ends never gets them; the row
    that ``close`` writes moves the watermark past all others, and the operators drop it by its null key.
    """

    def __init__(self, spark: SparkSession, folder: str, time: str):
        self.spark, self.folder, self.time = spark, folder, time
        spark.createDataFrame([], self._schema).write.mode("overwrite").parquet(folder)

    @property
    def _schema(self) -> str:
        return f"{self.time} timestamp_ntz"

    def join(self, stream: DataFrame) -> DataFrame:
        ends = self.spark.readStream.schema(self._schema).parquet(self.folder)
        return stream.unionByName(ends, allowMissingColumns=True)

    def close(self) -> None:
        row = self.spark.range(1).select(F.lit(CLOSING).cast("timestamp_ntz").alias(self.time))
        row.write.mode("append").parquet(self.folder)


def _watermarked(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """Rows under a watermark in ``_at``, without the closing row: a filter on the watermark's column stays behind it."""
    timed = rows.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    return timed.filter(F.col("_at") < F.lit(CLOSING).cast("timestamp"))


def _timed(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """Rows under a watermark, with their time as plain microseconds: so Spark hands late rows on instead of dropping them."""
    return _watermarked(rows, time, delay).withColumn("at", F.unix_micros("_at")).drop("_at")


def _ordered(rows: DataFrame, key: str, processor: Ordered, mode: str) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    return rows.groupBy(key).transformWithStateInPandas(
        processor, outputStructType=processor.output, outputMode=mode, timeMode="EventTime"
    )


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in (*pairs, ("late", T.BooleanType()))])


def changes(snaps: DataFrame, delay: str = WATERMARK, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Each snapshot beside the one before it in its site; late ones are marked ``late`` and have no predecessor."""
    id_type, site = snaps.schema["id"].dataType, snaps.schema["website_id"].dataType
    text, long = T.StringType(), T.LongType()
    output = _fields(
        ("website_id", site), ("id", id_type), ("at", long), ("content_hash", text), ("old_id", id_type), ("old_content_hash", text), ("old_at", long), ("is_first_snapshot", T.BooleanType())
    )
    rows = _timed(snaps, "captured_at", delay).select("website_id", "id", "at", "content_hash")
    return _ordered(rows, "website_id", Predecessor(output, bucket_ms), "Append")


def suppressed(alerts: DataFrame, delay: str = WATERMARK, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Alerts that pass suppression per ``website_id:alert_type``; late ones are marked ``late``.

    The state of a key goes two hours of event time after its last emission.
    """
    output = _fields(("id", alerts.schema["id"].dataType), ("key", T.StringType()), ("at", T.LongType()))
    key = F.concat_ws(":", "website_id", "alert_type").alias("key")
    rows = _timed(alerts, "created_at", delay).select(key, "id", "at", suppression_micros(F.col("severity")).alias("window"))
    return _ordered(rows, "key", Suppression(output, bucket_ms), "Append")


def patterns(snaps: DataFrame, delay: str = WATERMARK, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Change pattern of each site as its snapshots are released (``last_at`` says when); late ones are marked ``late``."""
    long, number = T.LongType(), T.DoubleType()
    output = _fields(
        ("website_id", snaps.schema["website_id"].dataType), ("history_size", long), ("change_count", long), ("change_frequency", number), ("avg_change_interval_seconds", number), ("last_at", long)
    )
    rows = _timed(snaps, "captured_at", delay).select("website_id", "id", "at", "content_hash")
    return _ordered(rows, "website_id", ChangePattern(output, bucket_ms), "Update")


def scan_counts(snaps: DataFrame, width: str = "1 hour", delay: str = WATERMARK) -> DataFrame:
    """Scans and defacements per tumbling window and site.

    In append mode a window is told once, when the watermark passes its end; rows for it that come later are dropped
    (``dropped_rows`` says how many).
    """
    return (
        _watermarked(snaps, "captured_at", delay)
        .groupBy(F.window("_at", width).alias("_w"), "website_id")
        .agg(F.count(F.lit(1)).alias("scan_count"), F.count_if(F.coalesce("is_defaced", F.lit(False))).alias("defacement_count"))
        .select(F.col("_w.start").cast("timestamp_ntz").alias("window_start"), "website_id", "scan_count", "defacement_count")
    )


def deliverable(alerts: DataFrame) -> DataFrame:
    """Alerts without repeats of an id that arrive within the watermark."""
    timed = alerts.withColumn("_at", F.col("created_at").cast("timestamp")).withWatermark("_at", WATERMARK)
    return timed.dropDuplicatesWithinWatermark(["id"]).drop("_at")


# --- sinks -----------------------------------------------------------------


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", send=None) -> StreamingQuery:
    """Write a stream to ``path`` and stop when the available input is used up.

    A micro-batch writes files of its own and then publishes them with one manifest, named by the batch. If the job is
    lost in between, the batch runs again and writes anew; what no manifest names is never read. If it is lost after,
    the batch finds its manifest, and what was published stays. ``send(df, batch_id)`` may deliver a published batch; it is called
    again if the job is lost before it has returned, with the same rows.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        name = f"{path}/_batches/{batch_id:012d}.json"
        target = f"{path}/data/{batch_id:012d}-{uuid.uuid4().hex}"
        df.write.parquet(target)  # also where the batch is published already: the query's state comes from this run
        if not manifest.exists(spark, name):
            manifest.publish(spark, name, {"batch_id": batch_id, "folder": target, "schema": df.schema.jsonValue()})
        if send is not None and not manifest.exists(spark, f"{path}/_sent/{batch_id:012d}.json"):
            known = manifest.load(spark, name)
            send(spark.read.schema(T.StructType.fromJson(known["schema"])).parquet(known["folder"]), batch_id)
            manifest.publish(spark, f"{path}/_sent/{batch_id:012d}.json", {"batch_id": batch_id})

    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def published(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All published rows of a sink, with their ``batch_id``. ``schema`` is for a sink that has published nothing yet."""
    known = [manifest.load(spark, f"{path}/_batches/{name}") for name in manifest.names(spark, f"{path}/_batches")]
    if not known:
        if schema is None:
            raise FileNotFoundError(f"nothing is published at {path}")
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("long"))
    rows = spark.read.schema(T.StructType.fromJson(known[-1]["schema"])).parquet(*[k["folder"] for k in known])
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return rows.withColumn("batch_id", F.substring_index(folder, "-", 1).cast("long"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", closing: Closing | None = None) -> DataFrame:
    """Run a stream over its available input and read the published rows; ``closing`` ends it, so nothing waits any more."""
    to_table(stream, path, checkpoint, mode).awaitTermination()
    if closing is not None:
        closing.close()
        to_table(stream, path, checkpoint, mode).awaitTermination()
    return published(stream.sparkSession, path, stream.schema)


def on_time(table: DataFrame) -> DataFrame:
    return table.filter(~F.col("late")).drop("late")


def late_rows(table: DataFrame) -> DataFrame:
    """The side output: rows that came after the watermark had passed them."""
    return table.filter("late").drop("late")


def dropped_rows(read: DataFrame, counts: DataFrame) -> int:
    """How many of the rows of a closed stream ``scan_counts`` (in append mode) has not counted."""
    counted = counts.agg(F.sum("scan_count")).first()[0] or 0
    return read.count() - counted


def last_update(table: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """The newest row per key of a table written in update mode; ``within`` orders the rows of one batch."""
    row = F.struct(*[c for c in table.columns if c not in (*keys, "batch_id")])
    newest = F.col("batch_id") if within is None else F.struct("batch_id", within)
    return table.groupBy(*keys).agg(F.max_by(row, newest).alias("_r")).select(*keys, "_r.*")
