"""Snapshot history: newest rows, predecessors, hash history, as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftwatch.operators.sliced import lag_over, last_over, newest, time_slice


def _newest_first():
    return [F.col("captured_at").desc(), F.col("id").desc()]


def latest_snapshot(snaps: DataFrame) -> DataFrame:
    """The newest snapshot of every site; ties go to the larger id."""
    best = F.max_by(F.struct(*snaps.columns), F.struct("captured_at", "id"))
    return snaps.groupBy("website_id").agg(best.alias("_s")).select("_s.*")


def recent_snapshots(snaps: DataFrame, limit: int = 50) -> DataFrame:
    """The newest ``limit`` snapshots of every site with their rank."""
    return newest(snaps, ["website_id"], _newest_first(), limit)


def snapshot_pairs(snaps: DataFrame, carry: list[str], slice_seconds: int = 86_400) -> DataFrame:
    """Every snapshot beside its predecessor's columns (``old_*``)."""
    columns = {"old_id": F.col("id"), **{f"old_{c}": F.col(c) for c in carry}}
    paired = lag_over(
        snaps, ["website_id"], ["captured_at", "id"], time_slice("captured_at", slice_seconds), columns
    )
    return paired.withColumn("is_first_snapshot", F.col("old_id").isNull())


def latest_hash(snaps: DataFrame, type_column: str | None = None) -> DataFrame:
    """Latest content hash per site, optionally per hash type."""
    keys = ["website_id"] + ([type_column] if type_column else [])
    return snaps.groupBy(*keys).agg(
        F.max_by("content_hash", F.struct("captured_at", "id")).alias("content_hash"),
        F.max("captured_at").alias("captured_at"),
    )


def hash_history(snaps: DataFrame, limit: int = 10) -> DataFrame:
    """The last ``limit`` hashes of every site, numbered in time order from 1."""
    kept = newest(snaps, ["website_id"], _newest_first(), limit)
    in_time = Window.partitionBy("website_id").orderBy(F.col("rank").desc())
    return kept.select(
        "website_id", "id", "content_hash", "captured_at", F.row_number().over(in_time).alias("position")
    )


def change_pattern(snaps: DataFrame, window_size: int = 5) -> DataFrame:
    """How often a site changed over its last ``2 * window_size`` hashes."""
    history = hash_history(snaps, limit=2 * window_size)
    # At most 2 * window_size rows per site are left here.
    order = Window.partitionBy("website_id").orderBy("position")
    steps = history.withColumns(
        {"_hash": F.lag("content_hash").over(order), "_at": F.lag("captured_at").over(order)}
    ).withColumn("_changed", F.col("_hash") != F.col("content_hash"))
    seconds = F.unix_micros(F.col("captured_at").cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp"))
    per_site = steps.groupBy("website_id").agg(
        F.count(F.lit(1)).alias("history_size"),
        F.count_if("_changed").alias("_n"),
        F.avg(F.when(F.col("_changed"), seconds / 1e6)).alias("_interval"),
    )
    enough = F.col("history_size") >= window_size
    frequency = F.when(enough & (F.col("_n") > 0), F.col("_n") / F.col("history_size"))
    return per_site.select(
        "website_id",
        "history_size",
        (~enough).alias("insufficient_data"),
        F.when(enough, F.col("_n")).alias("change_count"),
        frequency.alias("change_frequency"),
        F.when(enough, F.col("_interval")).alias("avg_change_interval_seconds"),
        (frequency > 0.3).alias("is_frequently_changing"),
        F.when(enough, F.coalesce(frequency < 0.1, F.lit(True))).alias("is_stable"),
    )


def previous_classification(snaps: DataFrame, depth: int = 5) -> DataFrame:
    """Newest decided verdict among the ``depth`` newest snapshots of a site."""
    decided = newest(snaps, ["website_id"], _newest_first(), depth).filter(F.col("is_defaced").isNotNull())
    best = F.max_by(F.struct("is_defaced", "confidence_score", "captured_at"), F.struct("captured_at", "id"))
    score = F.col("_v.confidence_score")
    return decided.groupBy("website_id").agg(best.alias("_v")).select(
        "website_id",
        F.when(F.col("_v.is_defaced"), "defacement").otherwise("benign").alias("label"),
        F.when(score.isNull() | (score == 0), 0.5).otherwise(score).alias("confidence"),
        F.col("_v.captured_at").alias("classified_at"),
    )


def previous_at(
    probes: DataFrame, snaps: DataFrame, probe_time: str = "created_at", slice_seconds: int = 86_400
) -> DataFrame:
    """For each probe row, the site's latest snapshot at or before its time."""
    found = F.struct(F.col("id").alias("snapshot_id"), "content_hash", "captured_at")
    right = snaps.select(
        "website_id", F.col("captured_at").alias("_t"), F.lit(0).alias("_side"), F.col("id").alias("_id"),
        found.alias("_hit"), F.lit(None).cast("long").alias("probe_id"),
    )
    left = probes.select(
        "website_id", F.col(probe_time).alias("_t"), F.lit(1).alias("_side"), F.col("id").alias("_id"),
        F.lit(None).cast(right.schema["_hit"].dataType).alias("_hit"), F.col("id").alias("probe_id"),
    )
    both = right.unionByName(left)
    filled = last_over(
        both, ["website_id"], ["_t", "_side", "_id"], time_slice("_t", slice_seconds), {"_found": F.col("_hit")}
    )
    return filled.filter(F.col("_side") == 1).select(
        "probe_id", "website_id", F.col("_t").alias("probe_time"), "_found.snapshot_id", "_found.content_hash",
        "_found.captured_at",
    )
