"""Streaming queries replayed over the event files, checked against batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.plans.alert_queries import ALERT_COLS, suppress_sql
from driftwatch.plans.history_queries import PATTERN_SQL
from driftwatch.plans.registry import query
from driftwatch.plans.views import VIEW_SQL
from driftwatch.sources.schemas import schema
from driftwatch.sources.shared import shared_folder
from driftwatch.streaming import jobs


def streamed(t, view: str):
    """A derived view over the event files read as a stream."""
    events = jobs.read_files(t.spark, t.sf_dir, schema("events"), pattern="events.parquet")
    return t.spark.sql(VIEW_SQL[view], events=events)


def replay(t, name: str, make, rows, time: str, mode: str = "append"):
    """The rows of a view as a stream that comes to its end, through ``make``."""
    closing = jobs.Closing(t.spark, shared_folder(t.spark, f"{name}-end"), time)
    stream = make(closing.join(rows))
    return jobs.run_to_table(stream, shared_folder(t.spark, name), shared_folder(t.spark, f"{name}-checkpoint"), mode, closing)


def instant(micros: str):
    return F.timestamp_micros(micros).cast("timestamp_ntz")


@query("stream_changes", ("snaps",), """
SELECT id, website_id, captured_at, content_hash, lag(id) OVER w AS old_id, lag(content_hash) OVER w AS old_content_hash, lag(captured_at) OVER w AS old_captured_at, lag(id) OVER w IS NULL AS is_first_snapshot
FROM snaps WINDOW w AS (PARTITION BY website_id ORDER BY captured_at, id)
""")
def stream_changes(t):
    out = jobs.on_time(replay(t, "changes", jobs.changes, streamed(t, "snaps"), "captured_at"))
    return out.select(
        "id", "website_id", instant("at").alias("captured_at"), "content_hash", "old_id", "old_content_hash",
        instant("old_at").alias("old_captured_at"), "is_first_snapshot",
    )


SUPPRESS_SQL = suppress_sql("alerts_dense").replace(f"SELECT {ALERT_COLS} FROM", "SELECT id, website_id || ':' || alert_type AS key, created_at FROM")


@query("stream_suppress", ("alerts_dense",), SUPPRESS_SQL, recursive=True)
def stream_suppress(t):
    out = jobs.on_time(replay(t, "suppress", jobs.suppressed, streamed(t, "alerts_dense"), "created_at"))
    return out.select("id", "key", instant("at").alias("created_at"))


@query("stream_scan_counts", ("snaps",), """
SELECT date_trunc('hour', captured_at) AS window_start, website_id, count(*) AS scan_count, count(*) FILTER (is_defaced) AS defacement_count FROM snaps GROUP BY 1, 2
""")
def stream_scan_counts(t):
    return replay(t, "scan-counts", jobs.scan_counts, streamed(t, "snaps"), "captured_at").drop("batch_id")


@query("stream_pattern", ("snaps",), PATTERN_SQL + """
SELECT website_id, history_size, change_count, change_frequency, avg_change_interval_seconds FROM change_pattern
""")
def stream_pattern(t):
    out = replay(t, "pattern", jobs.patterns, streamed(t, "snaps"), "captured_at", mode="update")
    out = jobs.last_update(jobs.on_time(out), ["website_id"], "last_at")
    interval = F.round("avg_change_interval_seconds", 3).alias("avg_change_interval_seconds")
    return out.select("website_id", "history_size", "change_count", "change_frequency", interval)


@query("stream_sink", ("alerts",), "SELECT id, website_id, alert_type, severity, created_at FROM alerts")
def stream_sink(t):
    """Every alert is delivered once although the stream carries each of them twice."""
    alerts = streamed(t, "alerts").select("id", "website_id", "alert_type", "severity", "created_at")
    stream = jobs.deliverable(alerts.unionByName(alerts))
    return jobs.run_to_table(stream, shared_folder(t.spark, "sink"), shared_folder(t.spark, "sink-checkpoint")).drop("batch_id")
