"""Explicit schemas of the monitoring tables."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_DDL = {
    "websites": (
        "id string, url string, name string, description string, check_interval_seconds int, is_active boolean, "
        "created_at timestamp_ntz, updated_at timestamp_ntz, last_checked_at timestamp_ntz"
    ),
    "website_snapshots": (
        "id string, website_id string, content_hash string, content_text string, raw_html binary, status_code int, "
        "response_time_ms double, content_length int, content_type string, vector_id string, similarity_score double, "
        "is_defaced boolean, confidence_score double, title string, meta_description string, structure_hash string, "
        "captured_at timestamp_ntz, analyzed_at timestamp_ntz"
    ),
    "defacement_alerts": (
        "id string, website_id string, snapshot_id string, alert_type string, severity string, title string, "
        "description string, classification_label string, confidence_score double, similarity_score double, status string, "
        "acknowledged_by string, acknowledged_at timestamp_ntz, resolved_at timestamp_ntz, notifications_sent int, "
        "last_notification_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "scheduled_jobs": (
        "job_id string, website_id string, job_type string, interval_expression string, priority int, enabled boolean, "
        "max_retries int, retry_delay double, status string, next_run_at timestamp_ntz, last_run_at timestamp_ntz, "
        "last_success_at timestamp_ntz, job_metadata string"
    ),
    "job_executions": (
        "execution_id string, job_id string, website_id string, job_type string, status string, priority int, "
        "attempt_number int, started_at timestamp_ntz, completed_at timestamp_ntz, duration_seconds double, "
        "error_message string, result_data string"
    ),
    "feedback": (
        "feedback_id string, website_id string, snapshot_id string, alert_id string, original_classification string, "
        "original_confidence double, feedback_type string, feedback_source string, corrected_classification string, "
        "corrected_confidence double, analyst_id string, metadata map<string,string>, created_at timestamp_ntz, "
        "processed_at timestamp_ntz"
    ),
    "vectors": "id string, embedding array<float>, payload map<string,string>",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def schema(table: str) -> T.StructType:
    """The schema of a table."""
    return T.StructType.fromDDL(SCHEMA_DDL[table])


def subset(table: str, columns: list[str]) -> T.StructType:
    """The schema of a table restricted to some columns, for a narrow scan."""
    full = schema(table)
    return T.StructType([full[c] for c in columns])
