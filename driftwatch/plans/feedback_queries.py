"""Queries over analyst feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.operators import feedback as fb
from driftwatch.plans.metrics_queries import rounded
from driftwatch.plans.registry import query
from driftwatch.plans.views import AS_OF, AS_OF_SQL


@query("feedback_rows", ("feedback",), """
SELECT CASE feedback_type WHEN 'false_positive' THEN 'feedback-fp-' || alert_id WHEN 'false_negative' THEN 'feedback-fn-' || (alert_id + 1) ELSE 'feedback-' || website_id END
    || '-' || CAST(floor(epoch(created_at)) AS BIGINT) AS feedback_id, website_id, alert_id + 1 AS snapshot_id, alert_id,
  CASE feedback_type WHEN 'false_positive' THEN 'defacement' WHEN 'false_negative' THEN 'benign' ELSE 'unclear' END AS original_classification,
  CASE WHEN feedback_type IN ('false_positive', 'false_negative') THEN CAST(0 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS original_confidence, feedback_type, feedback_source,
  CASE feedback_type WHEN 'false_positive' THEN 'benign' WHEN 'false_negative' THEN 'defacement' ELSE corrected_classification END AS corrected_classification,
  CASE feedback_type WHEN 'false_positive' THEN NULL WHEN 'false_negative' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS corrected_confidence, created_at FROM feedback
""")
def feedback_rows(t):
    submitted = t.feedback.withColumns(
        {
            "snapshot_id": F.col("alert_id") + 1,
            "original_classification": F.lit("unclear"),
            "original_confidence": F.lit(0.6),
            "corrected_confidence": F.lit(0.7),
        }
    )
    return fb.feedback_rows(submitted)


@query("action_mapping", ("feedback",), """
, a AS (SELECT feedback_id, CASE feedback_id % 5 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'confirm_defacement' WHEN 2 THEN 'mark_benign' WHEN 3 THEN 'needs_review' ELSE 'other' END AS action FROM feedback)
SELECT feedback_id, action, CASE action WHEN 'false_positive' THEN 'false_positive' WHEN 'confirm_defacement' THEN 'classification_correction' WHEN 'mark_benign' THEN 'classification_correction'
  WHEN 'needs_review' THEN 'manual_review' ELSE 'alert_feedback' END AS feedback_type,
  CASE action WHEN 'false_positive' THEN 'benign' WHEN 'confirm_defacement' THEN 'defacement' WHEN 'mark_benign' THEN 'benign' END AS corrected_classification FROM a
""")
def action_mapping(t):
    names = F.array(*map(F.lit, ("false_positive", "confirm_defacement", "mark_benign", "needs_review", "other")))
    actions = t.feedback.select("feedback_id", names[(F.col("feedback_id") % 5).cast("int")].alias("action"))
    return fb.map_actions(actions)


@query("enrich_feedback", ("feedback", "alerts"), """
SELECT feedback_id, coalesce(a.website_id, f.website_id) AS website_id, CASE WHEN a.id IS NULL THEN coalesce(f.original_classification, 'unclear') WHEN a.alert_type LIKE 'defacement%' THEN 'defacement' ELSE 'benign' END AS original_classification,
  CASE WHEN a.id IS NULL THEN coalesce(f.original_confidence, 0) ELSE CAST(a.id % 10 AS DOUBLE) / 10 END AS original_confidence FROM feedback f LEFT JOIN alerts a ON a.id = f.alert_id
""")
def enrich_feedback(t):
    alerts = t.alerts.withColumns(
        {
            "classification_label": F.when(F.col("alert_type").startswith("defacement"), "defacement").otherwise("benign"),
            "confidence_score": (F.col("id") % 10).cast("double") / 10,
        }
    )
    return fb.enrich(t.feedback, alerts).select("feedback_id", "website_id", "original_classification", "original_confidence")


def quality_sql(counts: str, keys: str = "") -> str:
    return f"""
q1 AS (SELECT {keys} coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, fp, fn, c + fp + fn AS n FROM ({counts}) z),
q2 AS (SELECT {keys} CAST(round(p, 6) AS DOUBLE) AS precision, CAST(round(r, 6) AS DOUBLE) AS recall, CAST(round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS DOUBLE) AS f1_score,
  CAST(round(coalesce(fp / nullif(n, 0), 0), 6) AS DOUBLE) AS false_positive_rate, CAST(round(coalesce(fn / nullif(n, 0), 0), 6) AS DOUBLE) AS false_negative_rate, n AS total_feedback_count FROM q1)"""


COUNTS = """count(*) FILTER (feedback_type = 'classification_correction') AS c, count(*) FILTER (feedback_type = 'classification_correction' AND corrected_classification = 'defacement') AS tp,
  count(*) FILTER (feedback_type = 'false_positive') AS fp, count(*) FILTER (feedback_type = 'false_negative') AS fn"""
MONTH = f"SELECT {COUNTS} FROM feedback WHERE created_at > {AS_OF_SQL} - INTERVAL 30 DAY AND created_at <= {AS_OF_SQL}"
PERIODS = f"""SELECT g.period, {COUNTS} FROM (SELECT unnest(range(1, 13)) AS period) g LEFT JOIN feedback f ON f.created_at > {AS_OF_SQL} - to_days(CAST((13 - g.period) * 7 AS INT))
  AND f.created_at <= {AS_OF_SQL} - to_days(CAST((12 - g.period) * 7 AS INT)) GROUP BY 1"""


@query("feedback_metrics", ("feedback",), "," + quality_sql(MONTH) + "SELECT * FROM q2")
def feedback_metrics(t):
    return rounded(fb.feedback_metrics(t.feedback, AS_OF), *fb.QUALITY)


@query("feedback_trends", ("feedback",), "," + quality_sql(PERIODS, "period,") + "SELECT * REPLACE (CAST(period AS INT) AS period) FROM q2")
def feedback_trends(t):
    return rounded(fb.feedback_trends(t.feedback, AS_OF), *fb.QUALITY)


@query("feedback_summary", ("feedback",), f"""
, d(dimension, value) AS (VALUES {", ".join(f"('type', '{v}')" for v in fb.FEEDBACK_TYPES)}, {", ".join(f"('source', '{v}')" for v in fb.FEEDBACK_SOURCES)}, ('total', 'all'))
SELECT dimension, value, count(f.feedback_id) AS n_feedback, count(f.feedback_id) FILTER (created_at > {AS_OF_SQL} - INTERVAL 7 DAY AND created_at <= {AS_OF_SQL}) AS recent_count,
  round(count(f.feedback_id) FILTER (created_at > {AS_OF_SQL} - INTERVAL 7 DAY AND created_at <= {AS_OF_SQL}) / 7, 6) AS avg_daily_feedback
FROM d LEFT JOIN feedback f ON (dimension = 'type' AND feedback_type = value) OR (dimension = 'source' AND feedback_source = value) OR dimension = 'total' GROUP BY 1, 2
""")
def feedback_summary(t):
    return rounded(fb.feedback_summary(t.feedback, AS_OF), "avg_daily_feedback")


@query("retrain_trigger", ("feedback",), """
, w AS (SELECT created_at, count(*) OVER (ORDER BY created_at RANGE BETWEEN INTERVAL '7' DAY PRECEDING AND CURRENT ROW) AS n, count(*) OVER (PARTITION BY created_at) AS k,
  count(*) OVER (ORDER BY created_at RANGE BETWEEN INTERVAL '7' DAY PRECEDING AND INTERVAL '7' DAY PRECEDING) AS edge FROM feedback)
SELECT DISTINCT created_at, k AS new_feedback, n - edge AS recent_feedback, n - edge >= 10 AS retrain FROM w
""")
def retrain_trigger(t):
    return fb.retrain_trigger(t.feedback)


ADVICE = """array_to_string(list_filter([CASE WHEN m.precision < 0.8 THEN 'Consider adjusting classification thresholds to reduce false positives' END,
  CASE WHEN m.recall < 0.8 THEN 'Review detection rules to improve coverage of defacement patterns' END,
  CASE WHEN m.false_positive_rate > 0.1 THEN 'High false positive rate - review and refine classification criteria' END,
  CASE WHEN (SELECT f1_score FROM q2 WHERE period = 11) <= (SELECT f1_score FROM q2 WHERE period = 10) AND (SELECT f1_score FROM q2 WHERE period = 12) <= (SELECT f1_score FROM q2 WHERE period = 11)
    THEN 'F1 score declining - consider model retraining or prompt updates' END], lambda x: x IS NOT NULL), '; ')"""
MONTH_SQL = quality_sql(MONTH).replace("q1", "m1").replace("q2", "m")


@query("quality_recommendations", ("feedback",), "," + quality_sql(PERIODS, "period,") + "," + MONTH_SQL + f"""
SELECT coalesce(nullif({ADVICE}, ''), 'Performance metrics are within acceptable ranges') AS recommendations FROM m""")
def quality_recommendations(t):
    out = fb.quality_recommendations(fb.feedback_metrics(t.feedback, AS_OF), fb.feedback_trends(t.feedback, AS_OF))
    return out.select(F.array_join("recommendations", "; ").alias("recommendations"))


@query("quality_report", ("feedback",), "," + quality_sql(PERIODS, "period,") + "," + MONTH_SQL + f"""
SELECT m.*, (SELECT string_agg(CAST(CAST(round(f1_score * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY period) FROM q2) AS f1_trend, (SELECT count(*) FROM feedback) AS total_count,
  (SELECT count(*) FROM feedback WHERE created_at > {AS_OF_SQL} - INTERVAL 7 DAY AND created_at <= {AS_OF_SQL}) AS recent_count,
  coalesce(nullif({ADVICE}, ''), 'Performance metrics are within acceptable ranges') AS recommendations FROM m""")
def quality_report(t):
    out = rounded(fb.quality_report(t.feedback, AS_OF), *fb.QUALITY)
    trend = F.transform("f1_trend", lambda x: F.round(x * 10000).cast("long").cast("string"))
    return out.withColumns({"f1_trend": F.array_join(trend, ","), "recommendations": F.array_join("recommendations", "; ")})
