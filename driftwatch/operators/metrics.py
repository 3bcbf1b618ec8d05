"""Site metrics, time series and job statistics.

``as_of`` is the reference time of a report; nothing here reads the clock.
Site facts are reduced to one row per site before they meet the site table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.operators.sliced import newest

DEFACEMENT_TYPES = ("defacement", "defacement_detected")

# Range name -> (span hours, bucket minutes).
RANGES = {"1h": (1, 5), "24h": (24, 60), "7d": (168, 360), "30d": (720, 1440)}


def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def before(as_of: str, hours: int) -> Column:
    return at(as_of) - F.expr(f"INTERVAL '{hours}' HOUR")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def _by_time(time: str):
    return [F.col(time).desc(), F.col("id").desc()]


def _measured(column: str = "response_time_ms") -> Column:
    """A response time of zero counts as not measured."""
    return F.when(F.col(column) != 0, F.col(column))


def _scan_totals(snaps: DataFrame) -> DataFrame:
    return snaps.groupBy("website_id").agg(
        F.count(F.lit(1)).alias("total_scans"),
        F.count_if(F.col("status_code") == 200).alias("successful_scans"),
        F.max("captured_at").alias("last_scan_time"),
        F.avg(_measured()).alias("_response"),
    )


def _defacements(alerts: DataFrame) -> DataFrame:
    return (
        alerts.filter(F.col("alert_type").isin(*DEFACEMENT_TYPES))
        .groupBy("website_id")
        .agg(F.count(F.lit(1)).alias("defacements_detected"))
    )


def _site_report(sites: DataFrame, facts: list[DataFrame], health: Column) -> DataFrame:
    out = sites.select(F.col("id").alias("website_id"), F.col("name").alias("website_name"), F.col("url").alias("website_url"))
    for fact in facts:
        out = out.join(fact, "website_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total_scans", "successful_scans", "defacements_detected")}
    staged = out.withColumns({**zero, "average_response_time_ms": F.coalesce("_response", F.lit(0.0))})
    scanned = F.col("total_scans") > 0
    share = F.col("successful_scans") / F.col("total_scans")
    return staged.withColumns(
        {
            "failed_scans": F.col("total_scans") - F.col("successful_scans"),
            "uptime_percentage": F.when(scanned, share * 100).otherwise(100.0),
            "health_score": F.when(scanned, health),
        }
    ).drop("_response")


def site_metrics(sites: DataFrame, snaps: DataFrame, alerts: DataFrame, depth: int | None = None) -> DataFrame:
    """Uptime and health of every site over all its snapshots, or its newest ``depth``."""
    recent = snaps if depth is None else newest(snaps, ["website_id"], _by_time("captured_at"), depth)
    share = F.col("successful_scans") / F.col("total_scans") * 10
    health = F.greatest(F.lit(0.0), share - F.col("defacements_detected") * 2)
    return _site_report(sites, [_scan_totals(recent), _defacements(alerts)], health)


def site_metrics_detail(sites: DataFrame, snaps: DataFrame, alerts: DataFrame) -> DataFrame:
    """Health over the full history with penalties for slowness and recent failures."""
    failures = (
        newest(snaps, ["website_id"], _by_time("captured_at"), 10)
        .groupBy("website_id")
        .agg(F.count_if(F.col("status_code") != 200).alias("recent_failures"))
    )
    slow = F.col("average_response_time_ms")
    score = (
        F.col("successful_scans") / F.col("total_scans") * 10
        - F.when(slow > 5000, 2).when(slow > 3000, 1).otherwise(0)
        - F.col("recent_failures") * 0.5
        - F.col("defacements_detected") * 3
    )
    health = F.greatest(F.lit(0.0), F.least(F.lit(10.0), score))
    report = _site_report(sites, [_scan_totals(snaps), _defacements(alerts), failures], health)
    return report.withColumn("recent_failures", F.coalesce("recent_failures", F.lit(0)))


def site_status(sites: DataFrame, snaps: DataFrame, alerts: DataFrame, depth: int = 10) -> DataFrame:
    """Current state of each site from its newest snapshots and alerts."""
    scans = (
        newest(snaps, ["website_id"], _by_time("captured_at"), depth)
        .groupBy("website_id")
        .agg(
            F.count(F.lit(1)).alias("recent_snapshots_count"),
            (F.count_if(F.col("status_code") == 200) / F.count(F.lit(1)) * 10).alias("health_score"),
        )
    )
    open_alerts = (
        newest(alerts, ["website_id"], _by_time("created_at"), depth)
        .groupBy("website_id")
        .agg(F.count_if(F.col("status") == "open").alias("active_alerts_count"))
    )
    out = sites.join(scans.withColumnRenamed("website_id", "id"), "id", "left").join(
        open_alerts.withColumnRenamed("website_id", "id"), "id", "left"
    )
    return out.select(
        "id", "name", "url", "is_active", "last_checked_at",
        F.when(F.col("is_active"), "active").otherwise("inactive").alias("monitoring_status"),
        F.coalesce("recent_snapshots_count", F.lit(0)).alias("recent_snapshots_count"),
        F.coalesce("active_alerts_count", F.lit(0)).alias("active_alerts_count"),
        "health_score",
    )


def metrics_summary(
    sites: DataFrame, snaps: DataFrame, alerts: DataFrame, as_of: str, depth: int | None = None
) -> DataFrame:
    """One row: site totals, scan and defacement counts, mean scan duration.

    All scans count, or the newest ``depth`` of every site.
    """
    today, week = F.to_date(at(as_of)), before(as_of, 168)
    site_row = sites.agg(
        F.count(F.lit(1)).alias("total_websites"), F.count_if("is_active").alias("active_websites")
    ).withColumn("inactive_websites", F.col("total_websites") - F.col("active_websites"))
    known = sites.select(F.col("id").alias("website_id"))
    scans = snaps if depth is None else newest(snaps, ["website_id"], _by_time("captured_at"), depth)
    recent = scans.join(known, "website_id", "left_semi")
    scan_row = recent.agg(
        F.count_if(F.to_date("captured_at") == today).alias("total_scans_today"),
        F.count_if(F.col("captured_at") >= week).alias("total_scans_this_week"),
        F.coalesce(F.avg(_measured()) / 1000, F.lit(0.0)).alias("average_scan_duration_seconds"),
        F.max("captured_at").alias("last_scan_time"),
    )
    hits = (
        alerts.filter(F.col("alert_type").isin(*DEFACEMENT_TYPES))
        .groupBy("website_id")
        .agg(
            F.count_if(F.to_date("created_at") == today).alias("_today"),
            F.count_if(F.col("created_at") >= week).alias("_week"),
        )
        .join(known, "website_id", "left_semi")
    )
    alert_row = hits.agg(
        F.coalesce(F.sum("_today"), F.lit(0)).alias("defacements_detected_today"),
        F.coalesce(F.sum("_week"), F.lit(0)).alias("defacements_detected_this_week"),
    )
    return site_row.crossJoin(scan_row).crossJoin(alert_row)


def system_status(sites: DataFrame, snaps: DataFrame, alerts: DataFrame, as_of: str) -> DataFrame:
    """One row: site totals, open alerts and activity of the last 24 hours."""
    day = before(as_of, 24)
    site_row = sites.agg(
        F.count(F.lit(1)).alias("total_websites"), F.count_if("is_active").alias("active_websites")
    ).withColumn("inactive_websites", F.col("total_websites") - F.col("active_websites"))
    alert_row = alerts.agg(
        F.count_if(F.col("status") == "open").alias("open_alerts"),
        F.count_if(F.col("created_at") >= day).alias("alerts_last_24h"),
    )
    scan_row = snaps.filter(F.col("captured_at") >= day).agg(
        F.count(F.lit(1)).alias("scans_last_24h"),
        F.count_if(F.coalesce("is_defaced", F.lit(False))).alias("defacements_last_24h"),
    )
    return site_row.crossJoin(alert_row).crossJoin(scan_row)


def page_of(df: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of an ordered list, every row with the ``total`` before paging."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    return rows.crossJoin(total)


def list_sites(sites: DataFrame, active_only: bool = True, page: int = 1, page_size: int = 20) -> DataFrame:
    chosen = sites.filter("is_active") if active_only else sites
    return page_of(chosen, [F.col("created_at"), F.col("id")], page, page_size)


def response_series(snaps: DataFrame, sites: DataFrame, as_of: str, span: str = "24h") -> DataFrame:
    """Raw response-time points of a range, labelled by site name."""
    points = snaps.filter((F.col("captured_at") >= before(as_of, RANGES[span][0])) & (F.col("response_time_ms") != 0))
    names = sites.select(F.col("id").alias("website_id"), F.col("name").alias("label"))
    return points.join(names, "website_id").select(
        F.col("captured_at").alias("timestamp"), F.col("response_time_ms").alias("value"), "label"
    )


def count_series(events: DataFrame, time: str, as_of: str, span: str = "24h") -> DataFrame:
    """Counts per tumbling bucket anchored at ``as_of`` minus the range.

    Empty buckets are kept; the last bucket may begin at ``as_of`` itself.
    """
    hours, minutes = RANGES[span]
    start = before(as_of, hours)
    width = minutes * 60
    frame = events.sparkSession.range(1).select(
        F.explode(F.sequence(start, at(as_of), F.expr(f"INTERVAL '{minutes}' MINUTE"))).alias("timestamp")
    ).withColumn("_bucket", F.floor(seconds_between(start, "timestamp") / width))
    end = F.lit(hours * 3600 // width + 1)
    counted = (
        events.filter(F.col(time) >= start)
        .select(F.floor(seconds_between(start, time) / width).alias("_bucket"))
        .filter(F.col("_bucket") < end)
        .groupBy("_bucket")
        .agg(F.count(F.lit(1)).cast("double").alias("_n"))
    )
    return frame.join(counted, "_bucket", "left").select("timestamp", F.coalesce("_n", F.lit(0.0)).alias("value"))


def scan_series(snaps: DataFrame, as_of: str, span: str = "24h") -> DataFrame:
    return count_series(snaps, "captured_at", as_of, span)


def defacement_series(alerts: DataFrame, as_of: str, span: str = "24h") -> DataFrame:
    return count_series(alerts.filter(F.col("alert_type").isin(*DEFACEMENT_TYPES)), "created_at", as_of, span)


def job_durations(jobs: DataFrame) -> DataFrame:
    """Adds ``duration_seconds``, null while a job has not finished."""
    return jobs.withColumn("duration_seconds", seconds_between("started_at", "completed_at"))


def _status(*names: str) -> Column:
    return F.count_if(F.col("status").isin(*names))


def job_stats(jobs: DataFrame, as_of: str) -> DataFrame:
    """Totals by status, success rate, hourly rate and mean duration in one pass."""
    done = F.col("status").isin("success", "failed")
    totals = job_durations(jobs).agg(
        F.count(F.lit(1)).alias("total_jobs"),
        _status("running").alias("active_jobs"),
        _status("success").alias("completed_jobs"),
        _status("failed").alias("failed_jobs"),
        _status("pending").alias("pending_jobs"),
        seconds_between(F.min("started_at"), at(as_of)).alias("uptime_seconds"),
        F.coalesce(F.avg(F.when(done, F.col("duration_seconds"))), F.lit(0.0)).alias("average_job_duration"),
    )
    executed = F.col("completed_jobs") + F.col("failed_jobs")
    return totals.withColumns(
        {
            "success_rate": F.col("completed_jobs") / F.greatest(executed, F.lit(1)),
            "jobs_per_hour": executed / F.greatest(F.col("uptime_seconds") / 3600, F.lit(1.0)),
        }
    )


def job_metrics_hour(jobs: DataFrame, as_of: str) -> DataFrame:
    """Finished, failed and mean duration within the hour before ``as_of``."""
    within = (F.col("completed_at") > before(as_of, 1)) & (F.col("completed_at") <= at(as_of))
    return job_durations(jobs).agg(
        F.count_if(within & (F.col("status") == "success")).alias("completed_jobs_last_hour"),
        F.count_if(within & (F.col("status") == "failed")).alias("failed_jobs_last_hour"),
        F.coalesce(F.avg(F.when(within, F.col("duration_seconds"))), F.lit(0.0)).alias("average_job_duration_seconds"),
        _status("running").alias("active_jobs"),
        _status("pending").alias("queue_size"),
    )


def worker_stats(jobs: DataFrame, as_of: str) -> DataFrame:
    """Per worker and overall (null worker): outcomes, rates, throughput.

    ``alerts_generated`` is an input column with the alerts each job raised.
    """
    grouped = jobs.rollup("worker_id").agg(
        _status("success", "failed").alias("jobs_processed"),
        _status("success").alias("jobs_succeeded"),
        _status("failed").alias("jobs_failed"),
        F.coalesce(F.sum("alerts_generated"), F.lit(0)).alias("alerts_generated"),
        (seconds_between(F.min("started_at"), at(as_of)) / 3600).alias("_hours"),
    )
    processed = F.greatest(F.col("jobs_processed"), F.lit(1))
    return grouped.withColumns(
        {
            "success_rate": F.col("jobs_succeeded") / processed,
            "alert_rate": F.col("alerts_generated") / processed,
            "throughput_jobs_per_hour": F.col("jobs_processed") / F.greatest(F.col("_hours"), F.lit(1.0)),
        }
    ).drop("_hours")


def retry_schedule(
    jobs: DataFrame, max_retries: int = 3, initial: float = 1.0, base: float = 2.0, max_delay: float = 300.0
) -> DataFrame:
    """Next attempt of failed jobs with exponential back-off; jitter as a range."""
    delay = F.least(initial * F.pow(F.lit(base), F.col("attempt_number") - 1), F.lit(max_delay))
    failed = jobs.filter((F.col("status") == "failed") & (F.col("attempt_number") < max_retries))
    return failed.select(
        "execution_id",
        "website_id",
        (F.col("attempt_number") + 1).alias("next_attempt"),
        delay.alias("delay_seconds"),
        (delay * 0.5).alias("delay_min_seconds"),
        (F.col("completed_at") + F.make_dt_interval(secs=delay)).alias("retry_at"),
    )


def retain_scans(snaps: DataFrame, keep: int = 20) -> DataFrame:
    """The newest ``keep`` scans of every site."""
    return newest(snaps, ["website_id"], _by_time("captured_at"), keep).drop("rank")


def retain_executions(jobs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return jobs.filter(F.col("started_at") >= before(as_of, days * 24))


def interval_seconds(interval: Column) -> Column:
    """Seconds of an interval text such as ``30s``, ``5m``, ``1h``, ``2d`` or ``45``."""
    number = F.regexp_extract(interval, r"^(\d+)([smhd]?)$", 1).try_cast("long")
    unit = F.regexp_extract(interval, r"^(\d+)([smhd]?)$", 2)
    return number * F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86_400).otherwise(1)


def sites_due(sites: DataFrame, as_of: str) -> DataFrame:
    """Active sites whose next check is due, most urgent first."""
    due = F.col("last_checked_at") + F.make_dt_interval(secs=interval_seconds(F.col("check_interval")))
    ready = sites.filter("is_active").withColumn("due_at", due).filter(F.col("due_at") <= at(as_of))
    return ready.select("id", "url", "priority", "due_at").orderBy("priority", "due_at", "id")


def crawl_summary(pages: DataFrame) -> DataFrame:
    """Pages, successful pages and errors per crawled site."""
    return pages.groupBy("website_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(F.col("status_code") == 200).alias("successful_pages"),
        F.count_if(F.col("status_code") != 200).alias("error_count"),
        seconds_between(F.min("captured_at"), F.max("captured_at")).alias("crawl_duration"),
    )


def search_logs(
    logs: DataFrame, as_of: str, since: str = "1h", level: str | None = None, component: str | None = None,
    page: int = 1, page_size: int = 50,
) -> DataFrame:
    """Newest log entries since a time (``Nh``, ``Nd`` or a timestamp; else 1 hour)."""
    if since[:-1].isdigit() and since[-1] in "hd":
        start = before(as_of, int(since[:-1]) * (24 if since[-1] == "d" else 1))
    else:
        start = F.coalesce(F.lit(since).try_cast("timestamp_ntz"), before(as_of, 1))
    found = logs.filter(F.col("ts") >= start)
    if level is not None:
        found = found.filter(F.lower("level") == level.lower())
    if component is not None:
        found = found.filter(F.lower("component").contains(component.lower()))
    return page_of(found, [F.col("ts").desc(), F.col("event_id").desc()], page, page_size)


