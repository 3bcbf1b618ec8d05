from __future__ import annotations

import datetime as dt

from driftwatch.operators import feedback as fb
from driftwatch.operators import history, metrics

NOW = dt.datetime(2024, 1, 30)
SITES = "id long, url string, name string, is_active boolean, created_at timestamp_ntz, last_checked_at timestamp_ntz"
SNAPS = "id long, website_id long, content_hash string, status_code int, response_time_ms double, captured_at timestamp_ntz, is_defaced boolean, confidence_score double"
ALERTS = "id long, website_id long, alert_type string, status string, created_at timestamp_ntz"


def sites(spark, n=2):
    return spark.createDataFrame([(i, f"u{i}", f"S{i}", True, NOW, NOW) for i in range(1, n + 1)], SITES)


def snap(i, minutes, status=200, ms=100.0, value="h", defaced=None, score=None):
    return (i, 1, value, status, ms, NOW - dt.timedelta(minutes=minutes), defaced, score)


def test_site_without_scans_is_up_and_has_no_health(spark):
    empty = spark.createDataFrame([], ALERTS)
    out = {r.website_id: r for r in metrics.site_metrics(sites(spark), spark.createDataFrame([snap(1, 5)], SNAPS), empty).collect()}
    assert out[2].uptime_percentage == 100.0 and out[2].health_score is None and out[2].total_scans == 0
    assert out[1].health_score == 10.0


def test_recent_failures_are_the_newest_ten(spark):
    rows = [snap(i, 1000 - i, 500 if i < 10 else 200) for i in range(30)]
    out = metrics.site_metrics_detail(sites(spark, 1), spark.createDataFrame(rows, SNAPS), spark.createDataFrame([], ALERTS)).first()
    assert out.recent_failures == 0 and abs(out.health_score - 20 / 30 * 10) < 1e-9


def test_both_defacement_types_count_and_zero_times_do_not(spark):
    alerts = [(1, 1, "defacement", "open", NOW), (2, 1, "defacement_detected", "open", NOW), (3, 1, "site_down", "open", NOW)]
    rows = [snap(1, 1, ms=0.0), snap(2, 2, ms=50.0)]
    out = metrics.site_metrics(sites(spark, 1), spark.createDataFrame(rows, SNAPS), spark.createDataFrame(alerts, ALERTS)).first()
    assert out.defacements_detected == 2 and out.average_response_time_ms == 50.0 and out.health_score == 6.0


def test_buckets_are_anchored_and_keep_zeros(spark):
    rows = [snap(1, 24 * 60), snap(2, 24 * 60 - 59), snap(3, 0), snap(4, 24 * 60 + 1)]
    out = metrics.scan_series(spark.createDataFrame(rows, SNAPS), str(NOW), "24h").orderBy("timestamp").collect()
    assert len(out) == 25 and out[0].value == 2.0 and out[-1].value == 1.0 and sum(r.value for r in out) == 3.0


def test_change_pattern_bands(spark):
    few = [snap(i, 100 - i) for i in range(4)]
    assert history.change_pattern(spark.createDataFrame(few, SNAPS)).first().insufficient_data
    calm = history.change_pattern(spark.createDataFrame([snap(i, 100 - i) for i in range(12)], SNAPS)).first()
    assert calm.is_stable and calm.change_count == 0 and calm.history_size == 10
    busy = history.change_pattern(spark.createDataFrame([snap(i, 100 - i, value=str(i)) for i in range(12)], SNAPS)).first()
    assert busy.change_count == 9 and busy.avg_change_interval_seconds == 60.0 and busy.is_frequently_changing


def test_previous_verdict_defaults(spark):
    rows = [snap(1, 5, defaced=True, score=0.9), snap(2, 4, defaced=False, score=0.0), snap(3, 3)]
    out = history.previous_classification(spark.createDataFrame(rows, SNAPS)).first()
    assert out.label == "benign" and out.confidence == 0.5


def test_intervals(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("30s",), ("5m",), ("1h",), ("2d",), ("45",)], "i string")
    assert [r[0] for r in df.select(metrics.interval_seconds(F.col("i"))).collect()] == [30, 300, 3600, 172800, 45]


def test_trends_use_their_own_period(spark):
    rows = [(1, "false_positive", "benign", NOW - dt.timedelta(days=1)), (2, "classification_correction", "defacement", NOW - dt.timedelta(days=8))]
    df = spark.createDataFrame(rows, "feedback_id int, feedback_type string, corrected_classification string, created_at timestamp_ntz")
    out = {r.period: r for r in fb.feedback_trends(df, str(NOW)).collect()}
    assert len(out) == 12 and out[12].false_positive_rate == 1.0 and out[11].precision == 1.0 and out[1].total_feedback_count == 0
