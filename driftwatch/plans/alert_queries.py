"""Queries for alert generation, suppression, lifecycle, reports and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.operators import alerts as al
from driftwatch.operators import routing
from driftwatch.operators.history import change_pattern
from driftwatch.plans.ensemble_queries import ENSEMBLE_SQL, judged
from driftwatch.plans.history_queries import PATTERN_SQL
from driftwatch.plans.metrics_queries import RANKED_ALERTS, rounded
from driftwatch.plans.registry import query
from driftwatch.plans.views import AS_OF, AS_OF_SQL

ALERT_COLS = "id, website_id, snapshot_id, created_at, alert_type, severity, status, resolved_at, notifications_sent, acknowledged_by, acknowledged_at"


def context(t):
    """Combined verdicts with the change context an alert is judged on."""
    doc = F.col("doc_id")
    digits = doc.cast("string")
    return judged(t).withColumns(
        {
            "website_id": doc % 50,
            "website_name": F.concat(F.lit("Site "), (doc % 50).cast("string")),
            "website_url": F.concat(F.lit("https://site"), (doc % 50).cast("string"), F.lit(".example.com/")),
            "visual_significant": doc % 7 == 0,
            "triggered_rules": F.when(doc % 3 == 0, F.array(F.lit("defacement: a..."), F.lit("xss: b..."))).otherwise(
                F.when(doc % 3 == 1, F.array(F.lit("phishing: c..."))).otherwise(F.array().cast("array<string>"))
            ),
            "change_type": F.when(doc % 4 == 0, "content,structure,visual").when(doc % 4 == 1, "content,metadata").otherwise("content"),
            "change_items": F.array(F.when(doc % 9 == 0, "Added <SCRIPT src=x>").otherwise("Title changed")),
            "content_similarity": (doc % 10).cast("double") / 10,
            "change_frequency": (doc % 8).cast("double") / 8,
            "avg_change_interval_seconds": (doc % 100).cast("double") * 60,
            "llm_explanation": F.concat(F.lit("explanation "), digits, F.repeat(F.lit(" long words"), 30)),
            "llm_reasoning": F.concat(F.lit("reasoning "), digits, F.repeat(F.lit(" more words"), 30)),
        }
    )


ALERT_SQL = ENSEMBLE_SQL + """,
a1 AS (SELECT *, doc_id % 50 AS website_id, 'Site ' || (doc_id % 50) AS website_name, 'https://site' || (doc_id % 50) || '.example.com/' AS website_url,
  doc_id % 7 = 0 AS vis, CASE doc_id % 3 WHEN 0 THEN 'defacement: a..., xss: b...' WHEN 1 THEN 'phishing: c...' END AS rules,
  CASE doc_id % 4 WHEN 0 THEN 'content,structure,visual' WHEN 1 THEN 'content,metadata' ELSE 'content' END AS change_type, CAST(doc_id % 10 AS DOUBLE) / 10 AS cs FROM e5),
a2 AS (SELECT *, CASE WHEN final_label = 'defacement' THEN CASE WHEN lvl IN ('critical', 'very_high') THEN 'critical' WHEN lvl = 'high' THEN 'high' WHEN lvl = 'medium' THEN 'medium' ELSE 'low' END
  WHEN final_label = 'unclear' AND lvl IN ('critical', 'very_high', 'high') THEN 'medium' ELSE 'low' END AS base FROM a1
  WHERE final_label = 'defacement' OR (final_label = 'unclear' AND lvl IN ('critical', 'very_high', 'high')) OR vis OR rule_confidence > 0.7),
a3 AS (SELECT *, round(CASE base WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END + CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE 0 END + CASE WHEN vis THEN 0.3 ELSE 0 END
  + CASE WHEN doc_id % 3 = 0 THEN 0.4 ELSE 0 END + CASE WHEN doc_id % 9 = 0 THEN 0.8 ELSE 0 END + CASE WHEN doc_id % 10 < 3 THEN 0.6 ELSE 0 END
  + CASE WHEN doc_id % 8 > 4 AND doc_id % 100 < 60 THEN 0.3 ELSE 0 END, 6) AS pts FROM a2),
a4 AS (SELECT *, CASE WHEN pts >= 3.5 THEN 'critical' WHEN pts >= 2.5 THEN 'high' WHEN pts >= 1.5 THEN 'medium' ELSE 'low' END AS severity FROM a3),
a5 AS (SELECT *, CASE WHEN final_label = 'defacement' AND severity IN ('critical', 'high') THEN 'defacement_detected'
  WHEN final_label = 'unclear' THEN CASE WHEN lvl IN ('critical', 'very_high', 'high') THEN 'content_anomaly' ELSE 'classification_uncertainty' END ELSE 'suspicious_activity' END AS alert_type FROM a4),
a6 AS (SELECT *, CASE alert_type WHEN 'defacement_detected' THEN '🚨 Website Defacement Detected: ' WHEN 'suspicious_activity' THEN '⚠️ Suspicious Activity: '
    WHEN 'content_anomaly' THEN '📊 Content Anomaly Detected: ' ELSE '❓ Classification Uncertainty: ' END || website_name AS title,
  'Website: ' || website_url || chr(10) || CASE alert_type
  WHEN 'defacement_detected' THEN concat_ws(chr(10), 'Classification: Defacement', 'Confidence: ' || format('{:.2f}', conf) || ' (' || lvl || ')',
    'AI Analysis: ' || substr('explanation ' || doc_id || repeat(' long words', 30), 1, 200) || '...', 'Triggered Rules: ' || rules, 'Content Similarity: ' || format('{:.2f}', cs))
  WHEN 'suspicious_activity' THEN concat_ws(chr(10), 'Suspicious patterns detected with ' || format('{:.2f}', conf) || ' confidence', 'Patterns: ' || rules, CASE WHEN vis THEN 'Visual changes detected' END)
  WHEN 'content_anomaly' THEN concat_ws(chr(10), 'Significant content changes detected', 'Analysis confidence: ' || format('{:.2f}', conf), 'Change types: ' || replace(change_type, ',', ', '))
  ELSE concat_ws(chr(10), 'Classification uncertain despite ' || lvl || ' confidence', 'Manual review recommended',
    'AI reasoning: ' || substr('reasoning ' || doc_id || repeat(' more words', 30), 1, 150) || '...') END AS description,
  CASE WHEN severity = 'critical' THEN 'URGENT: Immediate action required|' ELSE '' END || CASE alert_type
  WHEN 'defacement_detected' THEN 'Immediately verify website content|Check server logs for unauthorized access|Contact web administrator|Consider taking website offline if confirmed'
  WHEN 'suspicious_activity' THEN 'Review website content manually|Check for unauthorized script injections|Verify content changes are legitimate|Monitor closely for additional changes'
  WHEN 'content_anomaly' THEN 'Manual content review recommended|Verify changes are authorized|Check content management system logs'
  ELSE 'Manual classification needed|Review AI analysis results|Provide feedback to improve classification' END AS actions FROM a5)
"""


@query("alert_candidates", ("ensemble",), ALERT_SQL + "SELECT doc_id, final_label, lvl AS confidence_level FROM a2")
def alert_candidates(t):
    return al.alert_candidates(context(t)).select("doc_id", "final_label", "confidence_level")


@query("alert_severity", ("ensemble",), ALERT_SQL + """
SELECT doc_id, base AS base_severity, CAST(pts AS DOUBLE) AS severity_points, severity, concat_ws(',', CASE WHEN doc_id % 4 = 0 THEN 'multiple_changes' END, CASE WHEN vis THEN 'visual_changes' END,
  CASE WHEN doc_id % 3 = 0 THEN 'suspicious_patterns' END, CASE WHEN doc_id % 9 = 0 THEN 'script_injection' END, CASE WHEN doc_id % 10 < 3 THEN 'content_replacement' END,
  CASE WHEN doc_id % 8 > 4 AND doc_id % 100 < 60 THEN 'historical_anomaly' END) AS escalation_factors FROM a4""")
def alert_severity(t):
    out = al.alert_severity(al.alert_candidates(context(t)))
    return out.select(
        "doc_id", "base_severity", F.round("severity_points", 6).alias("severity_points"), "severity",
        F.array_join("escalation_factors", ",").alias("escalation_factors"),
    )


def raised(t):
    return al.raise_alerts(context(t))


@query("alert_type", ("ensemble",), ALERT_SQL + "SELECT doc_id, alert_type FROM a5")
def alert_type(t):
    return raised(t).select("doc_id", "alert_type")


@query("alert_text", ("ensemble",), ALERT_SQL + "SELECT doc_id, title, description FROM a6")
def alert_text(t):
    return raised(t).select("doc_id", "title", "description")


@query("alert_actions", ("ensemble",), ALERT_SQL + "SELECT doc_id, actions AS alert_actions FROM a6")
def alert_actions(t):
    return raised(t).select("doc_id", F.array_join("alert_actions", "|").alias("alert_actions"))


@query("alert_payload", ("ensemble",), ALERT_SQL + """
SELECT doc_id, title AS text, CASE severity WHEN 'critical' THEN 'danger' WHEN 'high' THEN 'warning' WHEN 'medium' THEN 'good' ELSE '#2eb886' END AS color,
  upper(severity[1]) || severity[2:] AS severity_value, format('{:.2f}', conf) AS confidence_value, description,
  'Recommended Actions:' || chr(10) || '• ' || replace(actions, '|', chr(10) || '• ') AS actions_value FROM a6""")
def alert_payload(t):
    out = al.alert_payload(raised(t))

    def path(p):
        return F.get_json_object("payload", p)

    field = "$.attachments[0].fields"
    return out.select(
        "doc_id", path("$.text").alias("text"), path("$.attachments[0].color").alias("color"),
        path(f"{field}[1].value").alias("severity_value"), path(f"{field}[3].value").alias("confidence_value"),
        path("$.attachments[0].text").alias("description"), path(f"{field}[4].value").alias("actions_value"),
    )


@query("raise_alerts", ("ensemble",), ALERT_SQL + """
SELECT doc_id, website_id, alert_type, severity, title, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS escalation_level,
  CASE WHEN severity IN ('critical', 'high') THEN '#defacement-alerts' ELSE '#security-monitoring' END AS channel, website_id || ':' || alert_type AS suppression_key FROM a6""")
def raise_alerts(t):
    return raised(t).select(
        "doc_id", "website_id", "alert_type", "severity", "title", "escalation_level", "channel", "suppression_key"
    )


@query("script_injection_flag", ("docs_planted",), """
SELECT doc_id, contains(lower(text), '<script') OR contains(lower(text), 'javascript:') OR contains(lower(text), 'eval(') OR contains(lower(text), 'iframe') AS script_injection FROM docs_planted
""")
def script_injection_flag(t):
    return t.docs_planted.select("doc_id", al.script_injection_flag(F.array("text")).alias("script_injection"))


@query("historical_anomaly", ("snaps",), PATTERN_SQL + """
SELECT website_id, change_frequency, round(avg_change_interval_seconds, 3) AS avg_change_interval_seconds FROM change_pattern WHERE change_frequency > 0.5 AND avg_change_interval_seconds < 3600 * 12
""")
def historical_anomaly(t):
    # scans here are half a day apart, so the hour is scaled by twelve
    patterns = change_pattern(t.snaps)
    scaled = patterns.withColumn("avg_change_interval_seconds", F.round("avg_change_interval_seconds", 3) / 12)
    found = al.historical_anomaly(scaled)
    return found.select(
        "website_id", "change_frequency", F.round(F.col("avg_change_interval_seconds") * 12, 3).alias("avg_change_interval_seconds")
    )


@query("escalation_level", ("alerts",), "SELECT id, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS escalation_level FROM alerts")
def escalation_level(t):
    return t.alerts.select("id", al.escalation_level(F.col("severity")).alias("escalation_level"))


@query("severity_channel", ("alerts",), "SELECT id, CASE WHEN severity IN ('critical', 'high') THEN '#defacement-alerts' ELSE '#security-monitoring' END AS channel FROM alerts")
def severity_channel(t):
    return t.alerts.select("id", al.severity_channel(F.col("severity")).alias("channel"))


def suppress_sql(view: str) -> str:
    """Walk the alerts of every key in order; one step emits or drops one alert."""
    return f"""
, o AS (SELECT id, website_id || ':' || alert_type AS k, epoch_us(created_at) AS ts,
  CAST(60000000 AS BIGINT) * CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 15 WHEN 'medium' THEN 30 ELSE 120 END AS win,
  row_number() OVER (PARTITION BY website_id, alert_type ORDER BY created_at, id) AS rn FROM {view}),
r AS (SELECT k, rn, id, true AS kept, ts AS last_ts FROM o WHERE rn = 1
  UNION ALL SELECT o.k, o.rn, o.id, o.ts - r.last_ts >= o.win, CASE WHEN o.ts - r.last_ts >= o.win THEN o.ts ELSE r.last_ts END FROM r JOIN o ON o.k = r.k AND o.rn = r.rn + 1)
SELECT {ALERT_COLS} FROM {view} WHERE id IN (SELECT id FROM r WHERE kept)"""


@query("suppress_alerts", ("alerts_dense",), suppress_sql("alerts_dense"), recursive=True)
def suppress_alerts(t):
    return al.suppress_alerts(t.alerts_dense)


@query("suppress_alerts_sparse", ("alerts",), suppress_sql("alerts"), recursive=True)
def suppress_alerts_sparse(t):
    return al.suppress_alerts(t.alerts)


def requested(t):
    """Two requests each for every fourth alert, one an hour after the other."""
    asked = t.alerts.filter(F.col("id") % 4 == 0).select("id")
    at = F.lit(AS_OF).cast("timestamp_ntz")
    late = asked.select("id", F.lit("second").alias("who"), (at + F.expr("INTERVAL '1' HOUR")).alias("at"))
    return late.unionByName(asked.select("id", F.lit("analyst").alias("who"), at.alias("at")))


@query("ack_alerts", ("alerts",), f"""
SELECT id, CASE WHEN id % 4 = 0 AND status = 'open' THEN 'acknowledged' ELSE status END AS status, CASE WHEN id % 4 = 0 AND status = 'open' THEN 'analyst' ELSE acknowledged_by END AS acknowledged_by,
  CASE WHEN id % 4 = 0 AND status = 'open' THEN {AS_OF_SQL} ELSE acknowledged_at END AS acknowledged_at FROM alerts
""")
def ack_alerts(t):
    asked = requested(t).withColumnsRenamed({"who": "acknowledged_by", "at": "acknowledged_at"})
    return al.acknowledge(t.alerts, asked).select("id", "status", "acknowledged_by", "acknowledged_at")


@query("resolve_alerts", ("alerts",), f"""
SELECT id, CASE WHEN id % 4 = 0 THEN 'resolved' ELSE status END AS status, CASE WHEN id % 4 = 0 AND status <> 'resolved' THEN {AS_OF_SQL} ELSE resolved_at END AS resolved_at FROM alerts
""")
def resolve_alerts(t):
    asked = requested(t).withColumnRenamed("at", "resolved_at")
    return al.resolve(t.alerts, asked).select("id", "status", "resolved_at")


@query("patch_alerts", ("alerts",), f"""
SELECT id, CASE WHEN id % 10 = 0 THEN 'acknowledged' WHEN id % 10 = 1 THEN 'resolved' ELSE status END AS status,
  CASE WHEN id % 10 = 0 THEN 'ops' ELSE acknowledged_by END AS acknowledged_by, CASE WHEN id % 10 = 0 THEN {AS_OF_SQL} ELSE acknowledged_at END AS acknowledged_at,
  CASE WHEN id % 10 = 1 THEN {AS_OF_SQL} ELSE resolved_at END AS resolved_at FROM alerts
""")
def patch_alerts(t):
    patches = t.alerts.filter(F.col("id") % 10 < 2).select(
        "id",
        F.when(F.col("id") % 10 == 0, "acknowledged").otherwise("resolved").alias("new_status"),
        F.lit("ops").alias("by"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("at"),
    )
    earlier = patches.withColumns({"by": F.lit("early"), "new_status": F.lit("open"), "at": F.col("at") - F.expr("INTERVAL '1' DAY")})
    out = al.patch(t.alerts, patches.unionByName(earlier))
    return out.select("id", "status", "acknowledged_by", "acknowledged_at", "resolved_at")


@query("bulk_ack", ("alerts",), f"""
SELECT e.event_id AS id, CASE WHEN a.id IS NULL THEN 'not_found' ELSE 'updated' END AS outcome, CASE WHEN a.status = 'open' THEN 'acknowledged' ELSE a.status END AS status,
  CASE WHEN a.status = 'open' THEN 'analyst' ELSE a.acknowledged_by END AS acknowledged_by, CASE WHEN a.status = 'open' THEN {AS_OF_SQL} ELSE a.acknowledged_at END AS acknowledged_at
FROM events e LEFT JOIN alerts a ON a.id = e.event_id WHERE e.event_id % 3 = 0
""")
def bulk_ack(t):
    """The alerts after the requests, beside the outcome of every requested id."""
    ids = t.events.filter(F.col("event_id") % 3 == 0).select(F.col("event_id").alias("id"))
    asked = ids.withColumns({"acknowledged_by": F.lit("analyst"), "acknowledged_at": F.lit(AS_OF).cast("timestamp_ntz")})
    updated, outcome = al.bulk_acknowledge(t.alerts, asked)
    return outcome.join(updated.select("id", "status", "acknowledged_by", "acknowledged_at"), "id", "left")


@query("suppress_alerts_named", ("alerts",), suppress_sql("alerts").replace(f"SELECT {ALERT_COLS} FROM", "SELECT md5(CAST(id AS VARCHAR)) AS id, website_id, created_at FROM"), recursive=True)
def suppress_alerts_named(t):
    """Suppression of alerts whose ids are text; no two alerts of a key share their time."""
    named = t.alerts.withColumn("id", F.md5(F.col("id").cast("string")))
    return al.suppress_alerts(named).select("id", "website_id", "created_at")


@query("list_alerts", ("alerts", "sites"), f"""
, f AS (SELECT * FROM alerts WHERE status = 'open' AND severity = 'high'), p AS (SELECT * FROM f ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20)
SELECT {", ".join("p." + c.strip() for c in ALERT_COLS.split(","))}, (SELECT count(*) FROM f) AS total, coalesce(s.name, 'Unknown') AS website_name
FROM p LEFT JOIN (SELECT * FROM sites WHERE is_active) s ON s.id = p.website_id
""")
def list_alerts(t):
    return al.list_alerts(t.alerts, t.sites.filter("is_active"), page=2, status="open", severity="high")


@query("open_alerts", ("alerts",), f"SELECT {ALERT_COLS} FROM alerts WHERE status = 'open' ORDER BY created_at DESC, id DESC LIMIT 50")
def open_alerts(t):
    return al.open_alerts(t.alerts, 50)


@query("alert_stats", ("alerts",), f"""
SELECT count(*) AS total_alerts, count(*) FILTER (status = 'open') AS open_alerts, count(*) FILTER (status = 'acknowledged') AS acknowledged_alerts, count(*) FILTER (status = 'resolved') AS resolved_alerts,
  count(*) FILTER (severity = 'critical') AS critical_alerts, count(*) FILTER (severity = 'high') AS high_alerts, count(*) FILTER (severity = 'medium') AS medium_alerts, count(*) FILTER (severity = 'low') AS low_alerts,
  count(*) FILTER (CAST(created_at AS DATE) = DATE '2024-01-30') AS alerts_today, count(*) FILTER (created_at >= {AS_OF_SQL} - INTERVAL 7 DAY) AS alerts_this_week,
  round(avg(CASE WHEN status = 'resolved' THEN (epoch_us(resolved_at) - epoch_us(created_at)) / 3.6e9 END), 6) AS avg_resolution_time_hours FROM alerts
""")
def alert_stats(t):
    return rounded(al.alert_stats(t.alerts, AS_OF), "avg_resolution_time_hours")


@query("alert_summary", ("alerts",), """
SELECT 'severity' AS section, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS position, severity AS label, count(*) AS n_alerts, CAST(NULL AS BIGINT) AS alert_id
FROM alerts GROUP BY severity
UNION ALL SELECT 'recent', CAST(rn AS INT), strftime(created_at, '%H:%M') || ' ' || severity, 1, id FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) rn FROM alerts) z WHERE rn <= 5
""")
def alert_summary(t):
    return al.alert_summary(t.alerts)


@query("alert_rate", ("alerts",), f"""
SELECT count(*) AS total_alerts, count(*) FILTER (status = 'open') AS open_alerts, count(*) FILTER (status = 'resolved') AS resolved_alerts, round(count(*) / 24, 6) AS alert_rate
FROM alerts WHERE created_at >= {AS_OF_SQL} - INTERVAL 24 HOUR AND created_at <= {AS_OF_SQL}
""")
def alert_rate(t):
    return rounded(al.alert_rate(t.alerts, AS_OF, 24), "alert_rate")


@query("undelivered_alerts", ("alerts",), f"SELECT {ALERT_COLS}, CAST(rn AS INT) AS rank FROM {RANKED_ALERTS} z WHERE rn <= 5 AND status = 'open' AND notifications_sent = 0")
def undelivered_alerts(t):
    return al.undelivered_alerts(t.alerts)


@query("site_down_alerts", ("snaps",), """
, s AS (SELECT *, count(*) FILTER (status_code = 200) OVER w AS grp, max(captured_at) FILTER (status_code = 200) OVER w AS ok_at FROM snaps
  WINDOW w AS (PARTITION BY website_id ORDER BY captured_at, id ROWS UNBOUNDED PRECEDING))
SELECT id, website_id, captured_at, status_code, row_number() OVER (PARTITION BY website_id, grp ORDER BY captured_at, id) - 1 AS retry_count, ok_at AS last_successful
FROM s WHERE status_code <> 200
""")
def site_down_alerts(t):
    return al.site_down_alerts(t.snaps)


RT = "CASE WHEN alert_type IN ('defacement', 'defacement_detected') THEN 'defacement' WHEN alert_type = 'site_down' THEN 'site_down' END"
TEMPLATE_SQL = f"""
, tpl(template_id, kind, priority, channels, users, sev, throttle, esc) AS (VALUES
  ('critical_defacement', 'defacement', 'critical', ['#security-alerts', '#incidents'], ['@security-team'], ['critical'], 5, 15),
  ('high_defacement', 'defacement', 'high', ['#security-alerts'], ['@on-call'], ['high'], 10, 30),
  ('standard_defacement', 'defacement', 'medium', ['#monitoring'], CAST([] AS VARCHAR[]), ['medium', 'low'], 15, 0),
  ('site_down_critical', 'site_down', 'high', ['#infrastructure', '#monitoring'], ['@sre-team'], NULL, 5, 20),
  ('system_error', 'system_error', 'medium', ['#monitoring'], ['@admin'], NULL, 30, 0),
  ('benign_change', 'benign_change', 'low', ['#monitoring'], CAST([] AS VARCHAR[]), NULL, 60, 0)),
m AS (SELECT a.*, {RT} AS rt, tpl.* FROM {{source}} a JOIN tpl ON tpl.kind = {RT} AND (tpl.sev IS NULL OR list_contains(tpl.sev, a.severity))
  UNION ALL SELECT a.*, {RT}, tpl.* FROM {{source}} a JOIN tpl ON tpl.template_id = 'standard_defacement' AND {RT} IS NULL)
"""


@query("route_alerts", ("alerts",), TEMPLATE_SQL.format(source="alerts") + """
SELECT id, rt AS router_type, string_agg(template_id, ',') AS template_ids, array_to_string(list_sort(list_distinct(flatten(list(channels)))), ',') AS channels,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(users)))), ','), '') AS users FROM m GROUP BY id, rt
""")
def route_alerts(t):
    out = routing.route_alerts(t.alerts)
    joined = {c: F.array_join(c, ",") for c in ("template_ids", "channels", "users")}
    return out.withColumns(joined).select("id", "router_type", *joined)


@query("route_alerts_by_table", ("alerts", "sites"), """
, own AS (SELECT 'site_' || id || '_' || sev AS template_id, 'defacement' AS kind, CASE WHEN id % 3 = 0 THEN 'critical' ELSE 'high' END AS priority, '#site-' || id AS channel, id AS site, sev FROM sites, (VALUES ('critical'), ('high'), ('low')) v(sev)),
m AS (SELECT a.id, o.template_id, CASE o.priority WHEN 'critical' THEN 0 ELSE 1 END AS rk, o.channel FROM alerts a JOIN own o ON a.alert_type IN ('defacement', 'defacement_detected') AND o.site = a.website_id AND (o.sev = a.severity OR a.severity IS NULL)
  UNION ALL SELECT a.id, 'any_down', 2, '#down' FROM alerts a WHERE a.alert_type = 'site_down'),
f AS (SELECT * FROM m UNION ALL SELECT id, 'standard_defacement', 2, '#monitoring' FROM alerts WHERE id NOT IN (SELECT id FROM m))
SELECT id, string_agg(template_id, ',' ORDER BY rk, template_id) AS template_ids, array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels FROM f GROUP BY id
""")
def route_alerts_by_table(t):
    """Three templates for every site, by severity, one for all sites that are down, and the fallback."""
    i, none = F.col("id").cast("string"), F.array().cast("array<string>")
    shape = lambda name, kind, priority, channel, conditions: [
        name.alias("template_id"), F.lit(kind).alias("alert_type"), priority.alias("priority"), F.array(channel).alias("channels"), none.alias("users"),
        conditions.alias("conditions"), F.lit(0).alias("throttle_minutes"), F.lit(0).alias("escalation_minutes"),
    ]
    by_site = F.create_map(F.lit("website_id"), F.array(i), F.lit("severity"), F.array("sev"), F.lit("no_such_column"), F.array(F.lit("x")))
    own = t.sites.withColumn("sev", F.explode(F.array(F.lit("critical"), F.lit("high"), F.lit("low")))).select(
        *shape(F.concat_ws("_", F.lit("site"), i, "sev"), "defacement", F.when(F.col("id") % 3 == 0, "critical").otherwise("high"), F.concat(F.lit("#site-"), i), by_site)
    )
    rest = t.spark.range(1)
    bare = F.create_map().cast("map<string,array<string>>")
    down = rest.select(*shape(F.lit("any_down"), "site_down", F.lit("medium"), F.lit("#down"), bare))
    spare = rest.select(*shape(F.lit("standard_defacement"), "none", F.lit("medium"), F.lit("#monitoring"), bare))
    out = routing.route_alerts(t.alerts, own.unionByName(down).unionByName(spare))
    return out.select("id", *[F.array_join(c, ",").alias(c) for c in ("template_ids", "channels")])


@query("throttle_notifications", ("alerts_dense",), TEMPLATE_SQL.format(source="(SELECT *, lag(created_at) OVER (PARTITION BY website_id, alert_type ORDER BY created_at, id) AS pt FROM alerts_dense)") + """
SELECT id, alert_type || '_' || website_id AS notification_key, created_at, template_id,
  throttle <= 0 OR pt IS NULL OR created_at - pt >= to_minutes(throttle) AS should_send FROM m
""")
def throttle_notifications(t):
    return routing.throttle_notifications(t.alerts_dense)


@query("escalations_due", ("alerts",), TEMPLATE_SQL.format(source="alerts") + f"""
SELECT id, template_id, created_at + to_minutes(esc) AS escalate_at FROM m WHERE status = 'open' AND esc > 0 AND created_at + to_minutes(esc) <= {AS_OF_SQL}
""")
def escalations_due(t):
    return routing.escalations_due(t.alerts, AS_OF)


@query("template_stats", ("alerts",), TEMPLATE_SQL.format(source="alerts") + f"""
SELECT t.template_id, t.kind AS alert_type, t.priority, CAST(len(t.channels) AS INT) AS n_channels, CAST(len(t.users) AS INT) AS n_users, count(m.id) AS recent_notifications_24h,
  t.throttle AS throttle_minutes, t.esc AS escalation_minutes FROM tpl t LEFT JOIN m ON m.template_id = t.template_id AND m.created_at > {AS_OF_SQL} - INTERVAL 24 HOUR AND m.created_at <= {AS_OF_SQL}
GROUP BY ALL
""")
def template_stats(t):
    return routing.template_stats(t.alerts, AS_OF)


@query("delivery_batches", ("alerts",), TEMPLATE_SQL.format(source="(SELECT *, (row_number() OVER (ORDER BY created_at, id) - 1) // 10 AS batch_no FROM alerts)") + """
SELECT DISTINCT id, unnest(channels) AS channel, CAST(batch_no AS BIGINT) AS batch_no FROM m
""")
def delivery_batches(t):
    return routing.delivery_batches(t.alerts)


@query("delivery_stats", ("alerts",), """
SELECT count(*) FILTER (notifications_sent > 0) AS messages_sent, count(*) FILTER (notifications_sent = 0) AS messages_failed, count(*) FILTER (id % 5 + 1 > 1) AS messages_retried FROM alerts
""")
def delivery_stats(t):
    return routing.delivery_stats(
        t.alerts.select((F.col("notifications_sent") > 0).alias("success"), (F.col("id") % 5 + 1).alias("attempts"))
    )


@query("alert_targets", ("sites",), """
SELECT id, alert_type, '#site-' || id || ',#ops' AS channels, '@owner-' || (id % 7) AS users FROM sites, (VALUES ('site_down'), ('defacement')) v(alert_type) WHERE id % 2 = 0
UNION ALL SELECT id, alert_type, '#direct', '' FROM sites, (VALUES ('site_down'), ('defacement')) v(alert_type) WHERE id % 2 = 1
""")
def alert_targets(t):
    site = F.col("id").cast("string")
    plain = F.array(F.concat(F.lit("#site-"), site), F.concat(F.lit("@owner-"), (F.col("id") % 7).cast("string")), F.lit("#ops"), F.lit("other"))
    even = F.col("id") % 2 == 0
    config = t.sites.select(
        "id",
        F.explode(F.array(F.lit("site_down"), F.lit("defacement"))).alias("alert_type"),
        F.when(even, plain).alias("targets"),
        F.when(~even, F.array(F.lit("#direct"))).alias("channels"),
        F.lit(None).cast("array<string>").alias("users"),
    )
    out = routing.alert_targets(config)
    return out.select("id", "alert_type", F.array_join("channels", ",").alias("channels"), F.array_join("users", ",").alias("users"))
