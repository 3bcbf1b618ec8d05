"""Queries for site metrics, time series, jobs and health reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.operators import health, metrics
from driftwatch.plans.registry import query
from driftwatch.plans.views import AS_OF, AS_OF_SQL

DEF = "('defacement', 'defacement_detected')"
NEWEST = "row_number() OVER (PARTITION BY website_id ORDER BY {t} DESC, id DESC)"
RANKED_SNAPS = f"(SELECT *, {NEWEST.format(t='captured_at')} rn FROM snaps)"
RANKED_ALERTS = f"(SELECT *, {NEWEST.format(t='created_at')} rn FROM alerts)"


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


SITE_FACTS = f"""
, s AS (SELECT website_id, count(*) n, count(*) FILTER (status_code = 200) ok, max(captured_at) mx,
  avg(response_time_ms) FILTER (response_time_ms <> 0) rt FROM {{source}} z GROUP BY 1),
f AS (SELECT website_id, count(*) FILTER (status_code <> 200) fails FROM {RANKED_SNAPS} z WHERE rn <= 10 GROUP BY 1),
d AS (SELECT website_id, count(*) c FROM alerts WHERE alert_type IN {DEF} GROUP BY 1),
b AS (SELECT w.id AS website_id, w.name AS website_name, w.url AS website_url, coalesce(n, 0) AS total_scans, coalesce(ok, 0) AS successful_scans,
  coalesce(n, 0) - coalesce(ok, 0) AS failed_scans, coalesce(c, 0) AS defacements_detected, mx AS last_scan_time,
  coalesce(rt, 0) AS art, CASE WHEN n > 0 THEN ok / n * 100 ELSE 100 END AS uptime, coalesce(fails, 0) AS fails
  FROM sites w LEFT JOIN s ON s.website_id = w.id LEFT JOIN d ON d.website_id = w.id LEFT JOIN f ON f.website_id = w.id)
SELECT website_id, website_name, website_url, total_scans, successful_scans, failed_scans, defacements_detected, last_scan_time,
  round(art, 6) AS average_response_time_ms, round(CAST(uptime AS DOUBLE), 6) AS uptime_percentage, """


@query("site_metrics", ("sites", "snaps", "alerts"), SITE_FACTS.format(source="snaps") + """
  CASE WHEN total_scans > 0 THEN round(greatest(0.0, successful_scans / total_scans * 10 - defacements_detected * 2), 6) END AS health_score FROM b""")
def site_metrics(t):
    out = metrics.site_metrics(t.sites, t.snaps, t.alerts)
    return rounded(out, "average_response_time_ms", "uptime_percentage", "health_score")


@query("site_metrics_detail", ("sites", "snaps", "alerts"), SITE_FACTS.format(source="snaps") + """
  fails AS recent_failures, CASE WHEN total_scans > 0 THEN round(greatest(0.0, least(10.0, successful_scans / total_scans * 10
  - CASE WHEN art > 5000 THEN 2 WHEN art > 3000 THEN 1 ELSE 0 END - fails * CAST(0.5 AS DOUBLE) - defacements_detected * 3)), 6) END AS health_score FROM b""")
def site_metrics_detail(t):
    out = metrics.site_metrics_detail(t.sites, t.snaps, t.alerts)
    return rounded(out, "average_response_time_ms", "uptime_percentage", "health_score")


@query("site_status", ("sites", "snaps", "alerts"), f"""
, s AS (SELECT website_id, count(*) n, count(*) FILTER (status_code = 200) ok FROM {RANKED_SNAPS} z WHERE rn <= 10 GROUP BY 1),
a AS (SELECT website_id, count(*) FILTER (status = 'open') o FROM {RANKED_ALERTS} z WHERE rn <= 10 GROUP BY 1)
SELECT id, name, url, is_active, last_checked_at, CASE WHEN is_active THEN 'active' ELSE 'inactive' END AS monitoring_status,
  coalesce(n, 0) AS recent_snapshots_count, coalesce(o, 0) AS active_alerts_count, round(ok / n * 10, 6) AS health_score
FROM sites LEFT JOIN s ON s.website_id = id LEFT JOIN a ON a.website_id = id
""")
def site_status(t):
    return rounded(metrics.site_status(t.sites, t.snaps, t.alerts), "health_score")


@query("metrics_summary", ("sites", "snaps", "alerts"), f"""
, r AS (SELECT * FROM snaps)
SELECT (SELECT count(*) FROM sites) AS total_websites, (SELECT count(*) FROM sites WHERE is_active) AS active_websites,
  (SELECT count(*) FROM sites WHERE NOT is_active) AS inactive_websites,
  (SELECT count(*) FROM r WHERE CAST(captured_at AS DATE) = DATE '2024-01-30') AS total_scans_today,
  (SELECT count(*) FROM r WHERE captured_at >= {AS_OF_SQL} - INTERVAL 7 DAY) AS total_scans_this_week,
  (SELECT round(avg(response_time_ms) / 1000, 6) FROM r WHERE response_time_ms <> 0) AS average_scan_duration_seconds,
  (SELECT max(captured_at) FROM r) AS last_scan_time,
  (SELECT count(*) FROM alerts WHERE alert_type IN {DEF} AND CAST(created_at AS DATE) = DATE '2024-01-30') AS defacements_detected_today,
  (SELECT count(*) FROM alerts WHERE alert_type IN {DEF} AND created_at >= {AS_OF_SQL} - INTERVAL 7 DAY) AS defacements_detected_this_week
""")
def metrics_summary(t):
    return rounded(metrics.metrics_summary(t.sites, t.snaps, t.alerts, AS_OF), "average_scan_duration_seconds")


@query("system_status", ("sites", "snaps", "alerts"), f"""
SELECT (SELECT count(*) FROM sites) AS total_websites, (SELECT count(*) FROM sites WHERE is_active) AS active_websites,
  (SELECT count(*) FROM sites WHERE NOT is_active) AS inactive_websites, (SELECT count(*) FROM alerts WHERE status = 'open') AS open_alerts,
  (SELECT count(*) FROM alerts WHERE created_at >= {AS_OF_SQL} - INTERVAL 24 HOUR) AS alerts_last_24h,
  (SELECT count(*) FROM snaps WHERE captured_at >= {AS_OF_SQL} - INTERVAL 24 HOUR) AS scans_last_24h,
  (SELECT count(*) FROM snaps WHERE captured_at >= {AS_OF_SQL} - INTERVAL 24 HOUR AND is_defaced) AS defacements_last_24h
""")
def system_status(t):
    return metrics.system_status(t.sites, t.snaps, t.alerts, AS_OF)


@query("list_sites", ("sites",), """
SELECT *, (SELECT count(*) FROM sites WHERE is_active) AS total FROM sites WHERE is_active ORDER BY created_at, id LIMIT 20 OFFSET 20
""")
def list_sites(t):
    return metrics.list_sites(t.sites, page=2, page_size=20)


@query("ts_response_time", ("sites", "snaps"), f"""
SELECT captured_at AS timestamp, response_time_ms AS value, name AS label FROM snaps JOIN sites ON sites.id = website_id
WHERE captured_at >= {AS_OF_SQL} - INTERVAL 24 HOUR AND response_time_ms <> 0
""")
def ts_response_time(t):
    return metrics.response_series(t.snaps, t.sites, AS_OF, "24h").orderBy("timestamp")


def series_sql(source: str, time: str, hours: int, minutes: int) -> str:
    return f"""
, b AS (SELECT unnest(generate_series({AS_OF_SQL} - INTERVAL {hours} HOUR, {AS_OF_SQL}, INTERVAL {minutes} MINUTE)) AS timestamp)
SELECT timestamp, CAST(count(x.{time}) AS DOUBLE) AS value FROM b LEFT JOIN {source} x ON x.{time} >= b.timestamp AND x.{time} < b.timestamp + INTERVAL {minutes} MINUTE GROUP BY 1
"""


for _span, (_hours, _minutes) in metrics.RANGES.items():
    _suffix = "" if _span == "24h" else f"_{_span}"

    @query(f"ts_scan_count{_suffix}", ("snaps",), series_sql("snaps", "captured_at", _hours, _minutes))
    def ts_scan_count(t, span=_span):
        return metrics.scan_series(t.snaps, AS_OF, span)

    @query(f"ts_defacement_count{_suffix}", ("alerts",), series_sql(f"(SELECT * FROM alerts WHERE alert_type IN {DEF})", "created_at", _hours, _minutes))
    def ts_defacement_count(t, span=_span):
        return metrics.defacement_series(t.alerts, AS_OF, span)


@query("job_durations", ("jobs",), """
SELECT *, (epoch_us(completed_at) - epoch_us(started_at)) / 1e6 AS duration_seconds FROM jobs
""")
def job_durations(t):
    return metrics.job_durations(t.jobs)


@query("job_stats", ("jobs",), f"""
, a AS (SELECT count(*) n, count(*) FILTER (status = 'running') r, count(*) FILTER (status = 'success') ok, count(*) FILTER (status = 'failed') f,
  count(*) FILTER (status = 'pending') p, (epoch_us({AS_OF_SQL}) - epoch_us(min(started_at))) / 1e6 AS up,
  coalesce(avg(CASE WHEN status IN ('success', 'failed') THEN (epoch_us(completed_at) - epoch_us(started_at)) / 1e6 END), 0) AS d FROM jobs)
SELECT n AS total_jobs, r AS active_jobs, ok AS completed_jobs, f AS failed_jobs, p AS pending_jobs, round(up, 3) AS uptime_seconds, round(d, 6) AS average_job_duration,
  round(ok / greatest(ok + f, 1), 6) AS success_rate, round((ok + f) / greatest(up / 3600, 1), 6) AS jobs_per_hour FROM a
""")
def job_stats(t):
    out = metrics.job_stats(t.jobs, AS_OF)
    return rounded(rounded(out, "average_job_duration", "success_rate", "jobs_per_hour"), "uptime_seconds", digits=3)


@query("job_metrics_hour", ("jobs",), f"""
, w AS (SELECT *, completed_at > {AS_OF_SQL} - INTERVAL 1 HOUR AND completed_at <= {AS_OF_SQL} AS hit FROM jobs)
SELECT count(*) FILTER (hit AND status = 'success') AS completed_jobs_last_hour, count(*) FILTER (hit AND status = 'failed') AS failed_jobs_last_hour,
  coalesce(avg(CASE WHEN hit THEN (epoch_us(completed_at) - epoch_us(started_at)) / 1e6 END), 0) AS average_job_duration_seconds,
  count(*) FILTER (status = 'running') AS active_jobs, count(*) FILTER (status = 'pending') AS queue_size FROM w
""")
def job_metrics_hour(t):
    return metrics.job_metrics_hour(t.jobs, AS_OF)


@query("worker_stats", ("jobs", "alerts"), f"""
, j AS (SELECT jobs.*, CASE WHEN alerts.id IS NULL THEN 0 ELSE 1 END AS ag FROM jobs LEFT JOIN alerts ON alerts.snapshot_id = execution_id),
g AS (SELECT worker_id, count(*) FILTER (status IN ('success', 'failed')) p, count(*) FILTER (status = 'success') ok, count(*) FILTER (status = 'failed') f,
  CAST(sum(ag) AS BIGINT) ag, (epoch_us({AS_OF_SQL}) - epoch_us(min(started_at))) / 1e6 / 3600 AS h FROM j GROUP BY ROLLUP (worker_id))
SELECT worker_id, p AS jobs_processed, ok AS jobs_succeeded, f AS jobs_failed, ag AS alerts_generated, round(ok / greatest(p, 1), 6) AS success_rate,
  round(ag / greatest(p, 1), 6) AS alert_rate, round(p / greatest(h, 1), 6) AS throughput_jobs_per_hour FROM g
""")
def worker_stats(t):
    raised = t.alerts.select(F.col("snapshot_id").alias("execution_id"), F.lit(1).alias("alerts_generated"))
    jobs = t.jobs.join(raised, "execution_id", "left").withColumn(
        "alerts_generated", F.coalesce("alerts_generated", F.lit(0))
    )
    return rounded(metrics.worker_stats(jobs, AS_OF), "success_rate", "alert_rate", "throughput_jobs_per_hour")


@query("retry_schedule", ("jobs",), """
SELECT execution_id, website_id, attempt_number + 1 AS next_attempt, least(pow(2.0, attempt_number - 1), 300.0) AS delay_seconds,
  least(pow(2.0, attempt_number - 1), 300.0) / 2 AS delay_min_seconds,
  completed_at + to_seconds(least(pow(2.0, attempt_number - 1), 300.0)) AS retry_at FROM jobs WHERE status = 'failed' AND attempt_number < 3
""")
def retry_schedule(t):
    return metrics.retry_schedule(t.jobs)


@query("retain_scans", ("snaps",), f"""
SELECT id, website_id, content_hash, status_code, response_time_ms, captured_at, is_defaced, confidence_score FROM {RANKED_SNAPS} z WHERE rn <= 20
""")
def retain_scans(t):
    return metrics.retain_scans(t.snaps, 20)


@query("retain_executions", ("jobs",), f"""
SELECT execution_id, status, started_at FROM jobs WHERE started_at >= {AS_OF_SQL} - INTERVAL 10 DAY
""")
def retain_executions(t):
    return metrics.retain_executions(t.jobs, AS_OF, days=10).select("execution_id", "status", "started_at")


@query("sites_due", ("sites",), f"""
SELECT id, url, CAST(1 + id % 5 AS BIGINT) AS priority, last_checked_at + to_seconds(check_interval_seconds) AS due_at FROM sites
WHERE is_active AND last_checked_at + to_seconds(check_interval_seconds) <= {AS_OF_SQL}
""")
def sites_due(t):
    sites = t.sites.withColumns(
        {
            "check_interval": F.concat((F.col("check_interval_seconds") / 60).cast("int").cast("string"), F.lit("m")),
            "priority": 1 + F.col("id") % 5,
        }
    )
    return metrics.sites_due(sites, AS_OF)


@query("crawl_summary", ("snaps",), """
SELECT website_id, count(*) AS total_pages, count(*) FILTER (status_code = 200) AS successful_pages, count(*) FILTER (status_code <> 200) AS error_count,
  round((epoch_us(max(captured_at)) - epoch_us(min(captured_at))) / 1e6, 3) AS crawl_duration FROM snaps GROUP BY 1
""")
def crawl_summary(t):
    return rounded(metrics.crawl_summary(t.snaps), "crawl_duration", digits=3)


@query("log_search", ("logs",), f"""
, f AS (SELECT * FROM logs WHERE ts >= {AS_OF_SQL} - INTERVAL 48 HOUR AND lower(level) = 'info' AND contains(lower(component), 'class'))
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50
""")
def log_search(t):
    return metrics.search_logs(t.logs, AS_OF, since="2d", level="info", component="Class", page=2)


HEALTH_SQL = """
, r AS (SELECT *, CAST(report_id % 11 AS DOUBLE) / 10 AS success_rate, CAST(report_id % 400 AS DOUBLE) AS average_job_duration FROM health),
s AS (SELECT *, (greatest(0.0, 1 - cpu_percent / 100) + greatest(0.0, 1 - memory_percent / 100) + greatest(0.0, 1 - disk_percent / 100)
  + CASE WHEN scraper_ok THEN 1 ELSE 0 END + CASE WHEN storage_ok THEN 1 ELSE 0 END + CASE WHEN total_jobs > 0 THEN success_rate ELSE 0 END)
  / (CASE WHEN total_jobs > 0 THEN 6 ELSE 5 END) AS score FROM r)
"""


def reports(t):
    return t.health.withColumns(
        {
            "success_rate": (F.col("report_id") % 11).cast("double") / 10,
            "average_job_duration": (F.col("report_id") % 400).cast("double"),
        }
    )


COMPONENTS = {"scraper": "scraper_ok", "storage": "storage_ok"}


def scored(t):
    return health.health_score(reports(t), list(COMPONENTS.values()))


@query("health_score", ("health",), HEALTH_SQL + "SELECT report_id, round(score, 6) AS health_score FROM s")
def health_score(t):
    return rounded(scored(t), "health_score").select("report_id", "health_score")


@query("resource_issues", ("health",), """
, i AS (SELECT report_id, list_filter([CASE WHEN cpu_percent > 85 THEN format('High CPU usage: {:.1f}%', cpu_percent) END,
  CASE WHEN memory_percent > 85 THEN format('High memory usage: {:.1f}%', memory_percent) END,
  CASE WHEN disk_percent > 90 THEN format('High disk usage: {:.1f}%', disk_percent) END], lambda x: x IS NOT NULL) AS l FROM health)
SELECT report_id, array_to_string(l, '; ') AS issues, len(l) = 0 AS healthy FROM i
""")
def resource_issues(t):
    out = health.resource_issues(t.health)
    return out.select("report_id", F.array_join("issues", "; ").alias("issues"), "healthy")


@query("health_recommendations", ("health",), HEALTH_SQL + """
SELECT report_id, array_to_string(list_filter([
  CASE WHEN cpu_percent > 80 THEN 'Consider reducing concurrent job limits due to high CPU usage' END,
  CASE WHEN memory_percent > 80 THEN 'High memory usage detected - consider increasing available memory' END,
  CASE WHEN disk_percent > 85 THEN 'Disk space running low - consider cleanup or expansion' END,
  CASE WHEN NOT scraper_ok AND NOT storage_ok THEN 'Address issues in: scraper, storage' WHEN NOT scraper_ok THEN 'Address issues in: scraper'
       WHEN NOT storage_ok THEN 'Address issues in: storage' END,
  CASE WHEN success_rate < 0.9 AND total_jobs > 10 THEN 'Job success rate is low - investigate failing jobs' END,
  CASE WHEN average_job_duration > 300 THEN 'Average job duration is high - consider optimization' END], lambda x: x IS NOT NULL), '; ') AS recommendations FROM s
""")
def health_recommendations(t):
    out = health.health_recommendations(reports(t), COMPONENTS)
    return out.select("report_id", F.array_join("recommendations", "; ").alias("recommendations"))


@query("health_alerts", ("health",), HEALTH_SQL + "SELECT report_id, generated_at, round(score, 6) AS health_score FROM s WHERE score < 0.7")
def health_alerts(t):
    return rounded(health.health_alerts(scored(t)), "health_score").select("report_id", "generated_at", "health_score")


def _joined(column: str) -> str:
    return f"string_agg(CAST(CAST(round({column} * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY generated_at, report_id)"


@query("health_trends", ("health",), HEALTH_SQL + f"""
SELECT {_joined('score')} AS health_scores, {_joined('cpu_percent')} AS cpu_usage, {_joined('memory_percent')} AS memory_usage,
  {_joined('success_rate')} AS job_success_rates FROM (SELECT * FROM s ORDER BY generated_at DESC, report_id DESC LIMIT 24) z
""")
def health_trends(t):
    out = health.health_trends(scored(t))
    return out.select(
        *[
            F.array_join(F.transform(c, lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias(c)
            for c in out.columns
        ]
    )


@query("health_rollup", ("health",), """
, c AS (SELECT report_id, unnest([CASE WHEN scraper_ok THEN 'healthy' ELSE 'critical' END, CASE WHEN storage_ok THEN 'healthy' ELSE 'critical' END,
  CASE WHEN cpu_percent > 80 THEN 'warning' ELSE 'healthy' END, CASE WHEN memory_percent > 80 THEN 'warning' ELSE 'healthy' END]) AS status FROM health),
g AS (SELECT report_id, count(*) n, count(*) FILTER (status = 'healthy') h, count(*) FILTER (status = 'warning') w, count(*) FILTER (status = 'critical') k FROM c GROUP BY 1)
SELECT report_id, n AS total_checks, h AS healthy_checks, w AS warning_checks, k AS critical_checks, round(h / n * 100, 1) AS health_score,
  CASE WHEN h / n >= 0.9 THEN 'healthy' WHEN h / n >= 0.7 THEN 'warning' ELSE 'critical' END AS overall_status FROM g
""")
def health_rollup(t):
    checks = t.health.select(
        "report_id",
        F.explode(
            F.array(
                F.when(F.col("scraper_ok"), "healthy").otherwise("critical"),
                F.when(F.col("storage_ok"), "healthy").otherwise("critical"),
                F.when(F.col("cpu_percent") > 80, "warning").otherwise("healthy"),
                F.when(F.col("memory_percent") > 80, "warning").otherwise("healthy"),
            )
        ).alias("status"),
    )
    return health.health_rollup(checks, ["report_id"])
