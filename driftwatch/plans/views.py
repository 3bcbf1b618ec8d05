"""Derived input views: monitoring tables expressed over the given base tables.

Each view is one SQL text that runs on Spark and on the checking engine alike,
so both sides of a check start from the same rows. ``{name}`` stands for a
base table or an earlier view.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from driftwatch.session import configure
from driftwatch.sources.tables import read_table, spread

#: Reference time of all time-relative operators in the registered queries.
AS_OF = "2024-01-30 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_ALERT_COLUMNS = """event_id AS snapshot_id, ts AS created_at,
  CASE event_type WHEN 'error' THEN 'site_down' WHEN 'purchase' THEN 'defacement_detected'
    WHEN 'click' THEN 'defacement' ELSE 'suspicious_activity' END AS alert_type,
  CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' ELSE 'resolved' END AS status,
  CASE WHEN event_id % 3 = 2 THEN ts + INTERVAL '6' HOUR ELSE NULL END AS resolved_at,
  CAST(event_id % 2 AS INT) AS notifications_sent,
  CASE WHEN event_id % 3 = 1 THEN 'first' END AS acknowledged_by,
  CASE WHEN event_id % 3 = 1 THEN ts + INTERVAL '1' HOUR ELSE NULL END AS acknowledged_at"""

VIEW_SQL: dict[str, str] = {
    "sites": """SELECT user_id AS id, concat('https://site', CAST(user_id AS STRING), '.example.com/') AS url,
  concat('Site ', CAST(user_id AS STRING)) AS name,
  CASE WHEN user_id % 3 = 0 THEN 300 WHEN user_id % 3 = 1 THEN 600 ELSE 900 END AS check_interval_seconds,
  user_id % 5 <> 0 AS is_active, min(ts) AS created_at, max(ts) AS last_checked_at,
  min(ts) + INTERVAL '1' DAY AS updated_at FROM {events} GROUP BY user_id""",
    "snaps": """SELECT event_id AS id, user_id AS website_id, md5(substr(props, 1, 7)) AS content_hash,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
  CASE WHEN event_type = 'signup' THEN CAST(0 AS DOUBLE) ELSE value * 100 END AS response_time_ms, ts AS captured_at,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type = 'purchase' END AS is_defaced,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) / 100 END AS confidence_score FROM {events}""",
    "alerts": f"""SELECT event_id AS id, user_id AS website_id, {_ALERT_COLUMNS}
  FROM {{events}} WHERE event_type <> 'view'""",
    "alerts_dense": f"""SELECT event_id AS id, user_id % 5 AS website_id, {_ALERT_COLUMNS}
  FROM {{events}} WHERE event_type <> 'view'""",
    "jobs": """SELECT event_id AS execution_id, user_id % 3 AS worker_id, user_id AS website_id,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' ELSE 'success' END AS status,
  CAST(event_id % 5 + 1 AS INT) AS attempt_number, ts AS started_at,
  CASE WHEN event_type IN ('error','view','purchase') THEN ts + INTERVAL '5' MINUTE ELSE NULL END AS completed_at FROM {events}""",
    "feedback": """SELECT event_id AS feedback_id, user_id AS website_id, event_id AS alert_id, ts AS created_at,
  CASE event_id % 5 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'false_negative' WHEN 2 THEN 'manual_review' ELSE 'classification_correction' END AS feedback_type,
  CASE event_type WHEN 'click' THEN 'slack_interaction' WHEN 'view' THEN 'external_system' ELSE 'human_analyst' END AS feedback_source,
  CASE WHEN event_id % 5 = 0 THEN 'benign' WHEN event_id % 5 = 1 OR event_id % 2 = 0 THEN 'defacement' ELSE 'benign' END AS corrected_classification,
  CASE WHEN event_id % 3 = 0 THEN 'defacement' END AS original_classification, CASE WHEN event_id % 3 = 0 THEN CAST(0.8 AS DOUBLE) END AS original_confidence
  FROM {events} WHERE event_id % 7 = 0""",
    "docs_planted": """SELECT doc_id, lang, source, concat(text, CASE doc_id % 13
  WHEN 0 THEN ' Hacked by zed. We are legion' WHEN 1 THEN ' new CoinHive.User( stratum+tcp://x' WHEN 2 THEN ' x or 1=1 union select a; drop table t'
  WHEN 3 THEN ' <script>eval(document.cookie)</script>' WHEN 4 THEN ' eval($_POST c99 shell base64_decode(' WHEN 5 THEN ' please verify your account unusual activity'
  WHEN 6 THEN ' <iframe width="0"> download.exe http://a.tk http://b.ml http://bit.ly/c' WHEN 7 THEN ' under maintenance scheduled downtime privacy policy cookie policy terms of service'
  WHEN 8 THEN ' hacked by q <script>x</script> union select 1 please verify your password' ELSE '' END) AS text FROM {documents}""",
    "doc_pairs": """SELECT doc_id AS pair_id, source, text AS new_text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS old_text FROM {documents}""",
    "verdicts": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('Sure: {{"classification": "Defacement", "confidence": ', CAST(doc_id % 10 AS STRING), ', "reasoning": "r"}} done')
  WHEN 1 THEN '{{"classification": "benign", "confidence": 0.8, "reasoning": "ok"}}' WHEN 2 THEN 'no json here' WHEN 3 THEN '{{"classification": broken}}'
  WHEN 4 THEN '{{"classification": "other", "confidence": -1}}' ELSE '{{"reasoning": "only"}}' END AS answer FROM {documents}""",
    "health": """SELECT event_id AS report_id, ts AS generated_at, least(value, CAST(100 AS DOUBLE)) AS cpu_percent, CAST(event_id % 101 AS DOUBLE) AS memory_percent,
  CAST(event_id % 97 AS DOUBLE) AS disk_percent, event_id % 4 <> 0 AS scraper_ok, event_id % 9 <> 0 AS storage_ok, CAST(event_id % 20 AS INT) AS total_jobs FROM {events} WHERE event_id % 10 = 0""",
    "logs": """SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
  CASE event_id % 4 WHEN 0 THEN 'scheduler' WHEN 1 THEN 'classifier' WHEN 2 THEN 'notification' ELSE 'api' END AS component, props AS message FROM {events}""",
    "vecs": """SELECT vec_id AS id, label AS website_id, embedding, CASE WHEN vec_id % 2 = 0 THEN 'main_content' ELSE 'title' END AS content_type, CAST(floor(vec_id / 2) AS BIGINT) AS pair_id FROM {embeddings}""",
    "ensemble": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'benign' WHEN 1 THEN 'defacement' ELSE 'unclear' END AS llm_label, CAST(doc_id % 11 AS DOUBLE) / 10 AS llm_confidence,
  CASE (doc_id + 1) % 3 WHEN 0 THEN 'benign' WHEN 1 THEN 'defacement' ELSE 'unclear' END AS rule_label, CAST(doc_id % 7 AS DOUBLE) / 6 AS rule_confidence,
  CASE doc_id % 5 WHEN 0 THEN 'defacement' WHEN 1 THEN 'xss' WHEN 2 THEN 'backdoor' WHEN 3 THEN 'phishing' ELSE 'unknown' END AS threat_category,
  CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS semantic_risk,
  CASE doc_id % 4 WHEN 0 THEN 'minimal' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'critical' END AS behavior_risk FROM {documents}""",
    "pages_injected": """SELECT page_id, url, replace(html, '</article>', concat(CASE page_id % 3
  WHEN 0 THEN '<img src="/a.png" alt="x" width="10"><form action="/go" method="POST"><input type="text" name="q" required></form>'
  WHEN 1 THEN '<main><p>injected main content</p><a title="a>b" href="/q">5 < 7 caf&#233; &eacute;t&eacute; &#x2014; end</a></main><div aria-hidden="true">gone</div>'
  ELSE '<p style="display: none">gone</p><a href="https://ext.example.org/z">out</a>' END, '</article>')) AS html FROM {pages}""",
}

#: The only view whose text differs per engine (array explosion).
PIXELS_CHECK_SQL = """SELECT vec_id AS image_id, label AS channel, pos - 1 AS pos, CAST(greatest(0, least(255, floor((x + 0.5) * 255))) AS INT) AS v
  FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)"""
#: The same rule in double precision, as the job computes it: floats below a whole number are not rounded up to it.
PIXELS_DOUBLE_CHECK_SQL = PIXELS_CHECK_SQL.replace("(x + 0.5)", "(CAST(x AS DOUBLE) + 0.5)")
PIXELS_SQL = """SELECT vec_id AS image_id, label AS channel, pos, CAST(greatest(0, least(255, floor((x + 0.5) * 255))) AS INT) AS v
  FROM (SELECT vec_id, label, posexplode(embedding) AS (pos, x) FROM {embeddings})"""

#: Base tables holding long text; worth spreading over all cores when small.
_TEXT_TABLES = {"documents", "pages"}


def _references(sql: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)


def view_ctes(names: tuple[str, ...]) -> str:
    """The named views as a comma-separated list of common table expressions."""
    out = []
    for name in names:
        if name == "pixels":
            text = PIXELS_CHECK_SQL
        elif name == "pixels_double":
            name, text = "pixels", PIXELS_DOUBLE_CHECK_SQL
        else:
            sql = VIEW_SQL[name]
            text = sql.format(**{ref: ref for ref in _references(sql)})
        out.append(f"{name} AS ({text})")
    return ",\n".join(out)


class Fixtures:
    """Lazy access to base tables and derived views as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")

    @cached_property
    def _tables(self) -> dict[str, DataFrame]:
        return {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = self._load(name)
        return self._tables[name]

    def _load(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            df = read_table(self.spark, f"{self.sf_dir}/{name}.parquet")
            return spread(df) if name in _TEXT_TABLES else df
        if name == "doc_pairs":
            return self._doc_pairs()
        sql = PIXELS_SQL if name == "pixels" else VIEW_SQL.get(name)
        if sql is None:
            raise AttributeError(name)
        return self.spark.sql(sql, **{ref: getattr(self, ref) for ref in _references(sql)})

    def _doc_pairs(self) -> DataFrame:
        """Each document beside the one before it from the same source."""
        from pyspark.sql import functions as F

        from driftwatch.operators.sliced import lag_over

        docs = self.documents.select(F.col("doc_id").alias("pair_id"), "source", F.col("text").alias("new_text"))
        return lag_over(
            docs, ["source"], ["pair_id"], F.floor(F.col("pair_id") / 4096), {"old_text": F.col("new_text")}
        )
