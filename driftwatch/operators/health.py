"""Health reports: scores, issues, recommendations, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.text import fixed

ALERT_THRESHOLD = 0.7


def health_score(reports: DataFrame, components: list[str]) -> DataFrame:
    """Adds ``health_score``: mean of resource headroom, component and job scores.

    ``success_rate`` takes part only where the report has jobs.
    """

    def headroom(column: str) -> Column:
        return F.greatest(F.lit(0.0), 1.0 - F.col(column) / 100)

    scores = [headroom(f"{r}_percent") for r in ("cpu", "memory", "disk")]
    scores += [F.when(F.col(c), 1.0).otherwise(0.0) for c in components]
    has_jobs = F.col("total_jobs") > 0
    total = sum(scores[1:], scores[0]) + F.when(has_jobs, F.col("success_rate")).otherwise(0.0)
    return reports.withColumn("health_score", total / (len(scores) + F.when(has_jobs, 1).otherwise(0)))


def resource_issues(reports: DataFrame) -> DataFrame:
    """Adds ``issues`` and ``healthy`` from the resource thresholds."""

    def issue(column: str, limit: float, name: str) -> Column:
        text = F.concat(F.lit(f"High {name} usage: "), fixed(F.col(column), 1), F.lit("%"))
        return F.when(F.col(column) > limit, text)

    found = F.array(
        issue("cpu_percent", 85.0, "CPU"), issue("memory_percent", 85.0, "memory"), issue("disk_percent", 90.0, "disk")
    )
    return reports.withColumn("issues", F.array_compact(found)).withColumn("healthy", F.size("issues") == 0)


def health_recommendations(reports: DataFrame, components: dict[str, str]) -> DataFrame:
    """Adds ``recommendations``; ``components`` maps a name to its ok column."""
    failing = F.array_compact(F.array(*[F.when(~F.col(ok), name) for name, ok in components.items()]))
    advice = F.array(
        F.when(F.col("cpu_percent") > 80, "Consider reducing concurrent job limits due to high CPU usage"),
        F.when(F.col("memory_percent") > 80, "High memory usage detected - consider increasing available memory"),
        F.when(F.col("disk_percent") > 85, "Disk space running low - consider cleanup or expansion"),
        F.when(F.size(failing) > 0, F.concat(F.lit("Address issues in: "), F.array_join(failing, ", "))),
        F.when(
            (F.col("success_rate") < 0.9) & (F.col("total_jobs") > 10),
            "Job success rate is low - investigate failing jobs",
        ),
        F.when(F.col("average_job_duration") > 300, "Average job duration is high - consider optimization"),
    )
    return reports.withColumn("recommendations", F.array_compact(advice))


def health_alerts(scored: DataFrame, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Reports whose score calls for an alert."""
    return scored.filter(F.col("health_score") < threshold)


def last_reports(reports: DataFrame, limit: int = 24) -> DataFrame:
    """The newest ``limit`` reports."""
    return reports.orderBy(F.col("generated_at").desc(), F.col("report_id").desc()).limit(limit)


def health_trends(scored: DataFrame, limit: int = 24) -> DataFrame:
    """One row of four arrays in time order over the newest reports."""
    recent = last_reports(scored, limit)
    points = F.array_sort(
        F.collect_list(
            F.struct("generated_at", "report_id", "health_score", "cpu_percent", "memory_percent", "success_rate")
        )
    )
    one = recent.agg(points.alias("_p"))
    return one.select(
        F.col("_p.health_score").alias("health_scores"),
        F.col("_p.cpu_percent").alias("cpu_usage"),
        F.col("_p.memory_percent").alias("memory_usage"),
        F.col("_p.success_rate").alias("job_success_rates"),
    )


def health_rollup(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Share of healthy checks and the overall state per group of checks."""

    def having(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    grouped = checks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_checks"),
        having("healthy").alias("healthy_checks"),
        having("warning").alias("warning_checks"),
        having("critical").alias("critical_checks"),
    )
    share = F.col("healthy_checks") / F.col("total_checks") * 100
    state = F.when(share >= 90, "healthy").when(share >= 70, "warning").otherwise("critical")
    return grouped.withColumns({"health_score": F.round(share, 1), "overall_status": state})
