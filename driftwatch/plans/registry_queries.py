"""Queries for table reads, the site registry, merges and deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.operators import metrics
from driftwatch.operators import registry as reg
from driftwatch.plans.metrics_queries import SITE_FACTS, rounded
from driftwatch.plans.registry import query
from driftwatch.plans.views import AS_OF, AS_OF_SQL
from driftwatch.sources import tables
from driftwatch.sources.cow import CopyOnWriteTable
from driftwatch.sources.schemas import schema, subset
from driftwatch.sources.shared import shared_folder


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def stored(t, name, rows, key="id"):
    """A fresh copy-on-write table of some rows."""
    return CopyOnWriteTable.create(rows, shared_folder(t.spark, name), key, buckets=16)


@query("load_table", (), "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def load_table(t):
    """A typed scan of the whole table."""
    return tables.read_table(t.spark, f"{t.sf_dir}/events.parquet", schema("events"))


@query("load_table_columns", (), "SELECT event_id, ts, user_id FROM events")
def load_table_columns(t):
    """A scan that reads three columns only."""
    return tables.read_table(t.spark, f"{t.sf_dir}/events.parquet", subset("events", ["event_id", "ts", "user_id"]))


@query("register_sites", ("sites",), f"""
, c AS (SELECT url, CASE WHEN page_id % 4 = 0 THEN 'Page ' || page_id END AS name, CASE WHEN page_id % 2 = 0 THEN 600 END AS i FROM pages
  UNION ALL SELECT url, NULL, NULL FROM pages UNION ALL SELECT url, 'again', 1 FROM sites),
g AS (SELECT url, min(name) AS name, min(i) AS i FROM c GROUP BY 1)
SELECT sha256(url)[1:16] AS id, url, coalesce(name, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS name, coalesce(i, 300) AS check_interval_seconds, true AS is_active, {AS_OF_SQL} AS created_at
FROM g WHERE url NOT IN (SELECT url FROM sites)
""")
def register_sites(t):
    even, fourth = F.col("page_id") % 2 == 0, F.col("page_id") % 4 == 0
    pages = t.pages.select(
        "url",
        F.when(fourth, F.concat(F.lit("Page "), F.col("page_id").cast("string"))).alias("name"),
        F.when(even, 600).alias("check_interval_seconds"),
    )
    plain = t.pages.select("url", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("check_interval_seconds"))
    known = t.sites.select("url", F.lit("again").alias("name"), F.lit(1).alias("check_interval_seconds"))
    return reg.register_sites(t.sites, pages.unionByName(plain).unionByName(known), now())


@query("append_snapshots", (), """
SELECT doc_id AS id, doc_id % 50 AS website_id, CASE WHEN doc_id % 5 = 0 THEN 404 ELSE 200 END AS status_code, CAST(length(text) AS INT) AS content_length, CAST(DATE '2024-01-30' AS DATE) AS captured_date FROM documents
""")
def append_snapshots(t):
    captures = t.documents.select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("website_id"), F.col("text").alias("content_text"),
        F.when(F.col("doc_id") % 5 == 0, 404).alias("status_code"), now().alias("captured_at"),
    )
    rows = reg.new_snapshots(captures)
    target = shared_folder(t.spark, "snapshots")
    tables.append(rows.drop("content_text"), target, "captured_at")
    stored = t.spark.read.parquet(target)
    return stored.select("id", "website_id", "status_code", "content_length", "captured_date")


@query("append_alerts", ("alerts",), """
SELECT id, website_id, CASE WHEN severity = 'low' THEN 'medium' ELSE severity END AS severity, 'open' AS status, 0 AS notifications_sent FROM alerts
""")
def append_alerts(t):
    raised = t.alerts.select("id", "website_id", F.when(F.col("severity") != "low", F.col("severity")).alias("severity"))
    rows = reg.new_alerts(raised)
    table = stored(t, "alerts", rows.filter(F.col("id") % 2 == 0))
    table.append(rows)  # every alert again: those that are there stay as they are
    return table.read()


@query("merge_analysis", ("snaps",), f"""
SELECT id, CASE WHEN id % 3 = 0 THEN true WHEN id % 3 = 1 THEN is_defaced ELSE is_defaced END AS is_defaced,
  CASE WHEN id % 3 = 1 THEN CAST(0.9 AS DOUBLE) ELSE confidence_score END AS confidence_score, CASE WHEN id % 3 < 2 THEN {AS_OF_SQL} END AS analyzed_at FROM snaps
""")
def merge_analysis(t):
    patch = t.snaps.filter(F.col("id") % 3 < 2).select(
        "id", F.when(F.col("id") % 3 == 0, True).alias("is_defaced"), F.when(F.col("id") % 3 == 1, 0.9).alias("confidence_score")
    )
    table = stored(t, "analysis", t.snaps.withColumn("analyzed_at", F.lit(None).cast("timestamp_ntz")))
    table.patch(patch, ["is_defaced", "confidence_score"], stamp=("analyzed_at", now()))
    return table.read().select("id", "is_defaced", "confidence_score", "analyzed_at")


@query("flag_snapshots", ("snaps",), f"""
SELECT id, CASE WHEN id % 4 = 3 THEN is_defaced ELSE id % 4 = 0 END AS is_defaced, CASE WHEN id % 4 = 3 THEN confidence_score ELSE CAST(id % 10 AS DOUBLE) / 10 END AS confidence_score,
  CASE WHEN id % 4 < 3 THEN {AS_OF_SQL} END AS analyzed_at FROM snaps
""")
def flag_snapshots(t):
    label = F.when(F.col("id") % 4 == 0, "defacement").when(F.col("id") % 4 == 1, "benign").otherwise("unclear")
    verdicts = t.snaps.filter(F.col("id") % 4 < 3).select("id", label.alias("final_label"), ((F.col("id") % 10).cast("double") / 10).alias("confidence_score"))
    patch = verdicts.select("id", (F.col("final_label") == "defacement").alias("is_defaced"), "confidence_score")
    merged = tables.merge_patch(t.snaps, patch, "id", ["is_defaced", "confidence_score"], ("analyzed_at", now()))
    return merged.select("id", "is_defaced", "confidence_score", "analyzed_at")


@query("update_sites", ("sites", "snaps"), f"""
SELECT id, CASE WHEN id % 2 = 0 THEN 'Renamed ' || id ELSE name END AS name, CASE WHEN id % 6 = 0 THEN 60 ELSE check_interval_seconds END AS check_interval_seconds,
  CASE WHEN id % 4 = 0 THEN false ELSE is_active END AS is_active, last_checked_at, CASE WHEN id % 2 = 0 THEN {AS_OF_SQL} ELSE updated_at END AS updated_at FROM sites
""")
def update_sites(t):
    i = F.col("id")
    patches = t.sites.filter(i % 2 == 0).select(
        "id", F.concat(F.lit("Renamed "), i.cast("string")).alias("name"), F.when(i % 6 == 0, 60).alias("check_interval_seconds"),
        F.when(i % 4 == 0, False).alias("is_active"),
    )
    stale = t.sites.withColumn("last_checked_at", F.col("created_at"))
    out = reg.update_sites(stale, patches, t.snaps, now())
    return out.select("id", "name", "check_interval_seconds", "is_active", "last_checked_at", "updated_at")


@query("set_monitoring", ("sites",), """
SELECT DISTINCT x.id, CASE WHEN s.id IS NULL THEN 'not_found' WHEN s.is_active THEN 'changed' ELSE 'unchanged' END AS outcome, CASE WHEN s.id IS NOT NULL THEN false END AS is_active
FROM (SELECT id FROM sites UNION ALL SELECT id + 100 FROM sites) x LEFT JOIN sites s ON s.id = x.id
""")
def set_monitoring(t):
    ids = t.sites.select("id").unionByName(t.sites.select((F.col("id") + 100).alias("id")))
    return reg.set_monitoring(t.sites, False, ids)


@query("set_monitoring_all", ("sites",), "SELECT id, CASE WHEN is_active THEN 'unchanged' ELSE 'changed' END AS outcome, true AS is_active FROM sites")
def set_monitoring_all(t):
    return reg.set_monitoring(t.sites, True)


@query("delete_sites_cascade", ("sites", "snaps", "alerts"), """
SELECT 'sites' AS table_name, id FROM sites WHERE is_active UNION ALL SELECT 'snaps', id FROM snaps WHERE website_id IN (SELECT id FROM sites WHERE is_active)
UNION ALL SELECT 'alerts', id FROM alerts WHERE website_id IN (SELECT id FROM sites WHERE is_active)
""")
def delete_sites_cascade(t):
    gone = t.sites.filter(~F.col("is_active")).select("id")
    kept = tables.delete_cascade(gone, t.sites, {"snaps": t.snaps, "alerts": t.alerts})
    parts = [df.select(F.lit(name).alias("table_name"), "id") for name, df in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("table_counts", ("sites", "snaps", "alerts", "jobs", "feedback", "health", "logs", "vecs"), """
, c AS (SELECT 'sites' AS table_name, count(*) AS n_rows FROM sites UNION ALL SELECT 'snaps', count(*) FROM snaps UNION ALL SELECT 'alerts', count(*) FROM alerts
  UNION ALL SELECT 'jobs', count(*) FROM jobs UNION ALL SELECT 'feedback', count(*) FROM feedback UNION ALL SELECT 'health', count(*) FROM health
  UNION ALL SELECT 'logs', count(*) FROM logs UNION ALL SELECT 'vecs', count(*) FROM vecs UNION ALL SELECT 'pages', count(*) FROM pages)
SELECT * FROM c UNION ALL SELECT 'total', CAST(sum(n_rows) AS BIGINT) FROM c
""")
def table_counts(t):
    names = ("sites", "snaps", "alerts", "jobs", "feedback", "health", "logs", "vecs", "pages")
    return tables.count_tables({name: getattr(t, name) for name in names})


EXPORT_SQL = SITE_FACTS.format(source="snaps").replace("\nSELECT website_id", ",\nreport AS (SELECT website_id", 1)


@query("export_metrics", ("sites", "snaps", "alerts"), EXPORT_SQL + "1 AS one FROM b) SELECT website_id, website_name, total_scans, uptime_percentage FROM report")
def export_metrics(t):
    """The site report written as CSV and read back."""
    report = rounded(metrics.site_metrics(t.sites, t.snaps, t.alerts), "uptime_percentage")
    target = shared_folder(t.spark, "export")
    report.select("website_id", "website_name", "total_scans", "uptime_percentage").write.csv(target, header=True)
    schema = "website_id bigint, website_name string, total_scans bigint, uptime_percentage double"
    return t.spark.read.schema(schema).csv(target, header=True)


@query("validate_sites", ("sites",), r"""
, s AS (SELECT CAST(page_id AS VARCHAR) AS id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'no spaces allowed here' WHEN 2 THEN regexp_replace(url, '^https?://', '') ELSE url END AS url,
  CASE WHEN page_id % 3 = 0 THEN '*/15 * * * *' WHEN page_id % 3 = 1 THEN '15m' END AS interval FROM pages UNION ALL SELECT 'site ' || id, url, '0 * * * *' FROM sites),
u AS (SELECT *, CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END AS f FROM s),
i AS (SELECT id, url, unnest([CASE WHEN url IS NULL THEN 'missing url' WHEN NOT regexp_matches(f, '(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$') THEN 'invalid url' END,
  CASE WHEN interval IS NOT NULL AND len(string_split(interval, ' ')) <> 5 THEN 'invalid interval' END,
  CASE WHEN length(id) < 3 THEN 'id too short' WHEN NOT regexp_matches(id, '^[a-zA-Z0-9_-]+$') THEN 'id has invalid characters' END]) AS issue FROM u)
SELECT id, url, issue FROM i WHERE issue IS NOT NULL
""")
def validate_sites(t):
    i = F.col("page_id")
    url = (
        F.when(i % 5 == 1, "no spaces allowed here")
        .when(i % 5 == 2, F.regexp_replace("url", "^https?://", ""))
        .when(i % 5 > 2, F.col("url"))
    )
    pages = t.pages.select(i.cast("string").alias("id"), url.alias("url"), F.when(i % 3 == 0, "*/15 * * * *").when(i % 3 == 1, "15m").alias("interval"))
    sites = t.sites.select(F.concat(F.lit("site "), F.col("id").cast("string")).alias("id"), "url", F.lit("0 * * * *").alias("interval"))
    return reg.validate_sites(pages.unionByName(sites))
