"""Queries over snapshot history and version pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.functions import text
from driftwatch.operators import changes, history
from driftwatch.operators.sliced import lag_over
from driftwatch.plans import sqltext as q
from driftwatch.plans.registry import query

SNAP_COLS = "id, website_id, content_hash, status_code, response_time_ms, captured_at, is_defaced, confidence_score"


@query("latest_snapshot", ("snaps",), f"""
SELECT {SNAP_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY captured_at DESC, id DESC) rn FROM snaps) z WHERE rn = 1
""")
def latest_snapshot(t):
    return history.latest_snapshot(t.snaps)


@query("recent_snapshots", ("snaps",), f"""
SELECT {SNAP_COLS}, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY captured_at DESC, id DESC) rn FROM snaps) z WHERE rn <= 50
""")
def recent_snapshots(t):
    return history.recent_snapshots(t.snaps, 50)


@query("snapshot_pairs", ("snaps",), """
SELECT id, website_id, captured_at, content_hash, lag(id) OVER w AS old_id, lag(content_hash) OVER w AS old_content_hash,
  lag(captured_at) OVER w AS old_captured_at, lag(id) OVER w IS NULL AS is_first_snapshot
FROM snaps WINDOW w AS (PARTITION BY website_id ORDER BY captured_at, id)
""")
def snapshot_pairs(t):
    snaps = t.snaps.select("id", "website_id", "captured_at", "content_hash")
    return history.snapshot_pairs(snaps, ["content_hash", "captured_at"])


@query("latest_hash", ("snaps",), """
SELECT website_id, content_hash, captured_at FROM (SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY captured_at DESC, id DESC) rn FROM snaps) z WHERE rn = 1
""")
def latest_hash(t):
    return history.latest_hash(t.snaps)


@query("latest_hash_by_type", ("snaps",), """
SELECT website_id, hash_type, content_hash, captured_at FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 'sha256' ELSE 'md5' END AS hash_type,
  row_number() OVER (PARTITION BY website_id, id % 2 ORDER BY captured_at DESC, id DESC) rn FROM snaps) z WHERE rn = 1
""")
def latest_hash_by_type(t):
    typed = t.snaps.withColumn("hash_type", F.when(F.col("id") % 2 == 0, "sha256").otherwise("md5"))
    return history.latest_hash(typed, "hash_type")


@query("hash_history", ("snaps",), """
SELECT website_id, id, content_hash, captured_at, CAST(row_number() OVER (PARTITION BY website_id ORDER BY captured_at, id) AS INT) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY captured_at DESC, id DESC) rn FROM snaps) z WHERE rn <= 10
""")
def hash_history(t):
    return history.hash_history(t.snaps)


PATTERN_SQL = """
, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY captured_at DESC, id DESC) rn FROM snaps) z WHERE rn <= 10),
s AS (SELECT *, lag(content_hash) OVER w AS ph, lag(captured_at) OVER w AS pt FROM h WINDOW w AS (PARTITION BY website_id ORDER BY rn DESC)),
g AS (SELECT website_id, count(*) AS n, count(*) FILTER (ph <> content_hash) AS c,
  avg(CASE WHEN ph <> content_hash THEN epoch_us(captured_at) - epoch_us(pt) END) / 1e6 AS gap FROM s GROUP BY 1),
change_pattern AS (SELECT website_id, n AS history_size, n < 5 AS insufficient_data, CASE WHEN n >= 5 THEN c END AS change_count,
  CASE WHEN n >= 5 AND c > 0 THEN c / n END AS change_frequency, CASE WHEN n >= 5 THEN round(gap, 3) END AS avg_change_interval_seconds,
  CASE WHEN n >= 5 AND c > 0 THEN c / n > 0.3 END AS is_frequently_changing,
  CASE WHEN n >= 5 THEN c = 0 OR c / n < 0.1 END AS is_stable FROM g)
"""


@query("change_pattern", ("snaps",), PATTERN_SQL + "SELECT * FROM change_pattern")
def change_pattern(t):
    interval = F.round("avg_change_interval_seconds", 3)
    return history.change_pattern(t.snaps).withColumn("avg_change_interval_seconds", interval)


@query("previous_classification", ("snaps",), """
SELECT website_id, CASE WHEN is_defaced THEN 'defacement' ELSE 'benign' END AS label,
  CASE WHEN confidence_score IS NULL OR confidence_score = 0 THEN 0.5 ELSE confidence_score END AS confidence, captured_at AS classified_at
FROM (SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY rn) k FROM
  (SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY captured_at DESC, id DESC) rn FROM snaps) z WHERE rn <= 5 AND is_defaced IS NOT NULL) y WHERE k = 1
""")
def previous_classification(t):
    return history.previous_classification(t.snaps)


@query("previous_at", ("snaps", "alerts"), """
SELECT a.id AS probe_id, a.website_id, a.created_at AS probe_time, s.id AS snapshot_id, s.content_hash, s.captured_at
FROM (SELECT id, website_id, created_at - INTERVAL '90' SECOND AS created_at FROM alerts) a
ASOF LEFT JOIN snaps s ON a.website_id = s.website_id AND a.created_at >= s.captured_at
""")
def previous_at(t):
    probes = t.alerts.select("id", "website_id", F.expr("created_at - INTERVAL '90' SECOND").alias("created_at"))
    return history.previous_at(probes, t.snaps)


def versions(t, *names: str):
    """Old and new version columns of each document, fingerprinted before pairing: those named, or all.

    Texts are read once and never shuffled; only fingerprints and keyword sets are. Columns travel packed, so the
    optimizer cannot leave out the ones that nobody reads.
    """
    body = F.col("text")
    fields = {
        "hash": text.content_digest(text.strip_dynamic(body)),
        "text": text.keyword_set(body),
        "title": F.substring(body, 1, 12),
        "meta_description": F.substring(body, 13, 3),
        "word_count": text.word_count(body),
        "structure_hash": F.md5(F.floor(F.length(body) / 400).cast("string")),
        "visual_hash": F.when(F.length(body) % 3 != 0, F.md5(F.substring(body, 1, 1))),
    }
    fields = {name: fields[name] for name in names or fields}
    docs = t.documents.select(
        F.col("doc_id").alias("pair_id"), "source", *[value.alias(f"new_{name}") for name, value in fields.items()]
    )
    old = {f"old_{name}": F.col(f"new_{name}") for name in fields} | {"old_pair_id": F.col("pair_id")}
    return lag_over(docs, ["source"], ["pair_id"], F.floor(F.col("pair_id") / 4096), old)


def _side(side: str) -> str:
    x = f"{side}_text"
    return f"""CASE WHEN {x} IS NOT NULL THEN sha256({q.stripped(x)}) END AS {side}_hash, substr({x}, 1, 12) AS {side}_title,
  substr({x}, 13, 3) AS {side}_meta_description, {q.words(x)} AS {side}_word_count,
  md5(CAST(length({x}) // 400 AS VARCHAR)) AS {side}_structure_hash,
  CASE WHEN length({x}) % 3 <> 0 THEN md5(substr({x}, 1, 1)) END AS {side}_visual_hash,
  list_distinct({q.keywords(f"coalesce({x}, '')")}) AS {side}_kw"""


_KS = f"(CASE WHEN coalesce(old_text, '') = '' OR coalesce(new_text, '') = '' THEN 0 ELSE {q.keyword_similarity('old_kw', 'new_kw')} END)"

VERSIONS_SQL = f"""
, v AS (SELECT *, {_side('old')}, {_side('new')} FROM doc_pairs),
c AS (SELECT *, old_hash <> new_hash AS content_hash_changed, CASE WHEN old_hash <> new_hash THEN {_KS} ELSE 1.0 END AS content_similarity,
  old_structure_hash <> new_structure_hash AS structure_hash_changed,
  CASE WHEN old_structure_hash <> new_structure_hash THEN 0.0 ELSE 1.0 END AS structure_similarity,
  CASE WHEN old_visual_hash = new_visual_hash THEN 1.0 WHEN old_visual_hash <> new_visual_hash THEN 0.0 END AS visual_similarity,
  list_filter([CASE WHEN coalesce(old_title, '') <> coalesce(new_title, '') THEN 'title' END,
    CASE WHEN coalesce(old_meta_description, '') <> coalesce(new_meta_description, '') THEN 'meta_description' END,
    CASE WHEN abs(coalesce(old_word_count, 0) - coalesce(new_word_count, 0)) / greatest(coalesce(old_word_count, 0), 1) > 0.1 THEN 'word_count' END],
    lambda x: x IS NOT NULL) AS metadata_changes FROM v)
"""


@query("content_compare", ("doc_pairs",), VERSIONS_SQL + """
SELECT pair_id, content_hash_changed, round(CAST(content_similarity AS DOUBLE), 6) AS content_similarity FROM c
""")
def content_compare(t):
    out = changes.content_compare(versions(t, "hash", "text"))
    return out.select("pair_id", "content_hash_changed", F.round("content_similarity", 6).alias("content_similarity"))


@query("structure_compare", ("doc_pairs",), VERSIONS_SQL + """
SELECT pair_id, structure_hash_changed, CAST(structure_similarity AS DOUBLE) AS structure_similarity FROM c
""")
def structure_compare(t):
    out = changes.structure_compare(versions(t, "structure_hash"), signatures=False)
    return out.select("pair_id", "structure_hash_changed", "structure_similarity")


@query("visual_hash_compare", ("doc_pairs",), VERSIONS_SQL + """
SELECT pair_id, CAST(visual_similarity AS DOUBLE) AS visual_similarity FROM c
""")
def visual_hash_compare(t):
    return changes.visual_hash_compare(versions(t, "visual_hash")).select("pair_id", "visual_similarity")


@query("metadata_compare", ("doc_pairs",), VERSIONS_SQL + """
SELECT pair_id, array_to_string(metadata_changes, ',') AS metadata_changes FROM c
""")
def metadata_compare(t):
    out = changes.metadata_compare(versions(t, "title", "meta_description", "word_count"))
    return out.select("pair_id", F.array_join("metadata_changes", ",").alias("metadata_changes"))


VERDICT_SQL = VERSIONS_SQL + """,
d AS (SELECT *, list_filter([CASE WHEN content_similarity < 0.85 THEN 'content' END, CASE WHEN structure_similarity < 0.9 THEN 'structure' END,
    CASE WHEN visual_similarity < 0.9 THEN 'visual' END, CASE WHEN len(metadata_changes) > 0 THEN 'metadata' END], lambda x: x IS NOT NULL) AS types,
  greatest(CASE WHEN content_similarity < 0.5 THEN 4 WHEN content_similarity < 0.7 THEN 3 WHEN content_similarity < 0.85 THEN 2 ELSE 1 END,
    CASE WHEN structure_similarity < 0.7 THEN 3 WHEN structure_similarity < 0.9 THEN 2 ELSE 1 END, CASE WHEN visual_similarity < 0.6 THEN 3 ELSE 1 END) AS risk,
  CAST(list_avg(list_filter([CAST(content_similarity AS DOUBLE), CAST(structure_similarity AS DOUBLE), CAST(visual_similarity AS DOUBLE)], lambda x: x IS NOT NULL)) AS DOUBLE) AS similarity_score
  FROM c WHERE old_text IS NOT NULL),
verdict AS (SELECT *, CASE WHEN len(types) = 0 THEN 'none' ELSE array_to_string(types, ',') END AS change_type, ['low','medium','high','critical'][risk] AS risk_level,
  (CASE WHEN old_hash IS NOT NULL AND new_hash IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN old_structure_hash IS NOT NULL AND new_structure_hash IS NOT NULL THEN 0.3 ELSE 0 END
   + CASE WHEN old_visual_hash IS NOT NULL AND new_visual_hash IS NOT NULL THEN 0.3 ELSE 0 END) AS confidence,
  similarity_score < 0.85 OR len(types) > 0 AS has_changed FROM d)
"""


def verdicts(t):
    pairs = versions(t).filter(F.col("old_pair_id").isNotNull())
    compared = changes.structure_compare(changes.content_compare(pairs), signatures=False)
    return changes.change_verdict(changes.metadata_compare(changes.visual_hash_compare(compared)))


@query("change_verdict", ("doc_pairs",), VERDICT_SQL + """
SELECT pair_id, has_changed, change_type, round(similarity_score, 6) AS similarity_score, risk_level, CAST(confidence AS DOUBLE) AS confidence FROM verdict
""")
def change_verdict(t):
    return verdicts(t).select(
        "pair_id", "has_changed", "change_type", F.round("similarity_score", 6).alias("similarity_score"),
        "risk_level", F.round("confidence", 6).alias("confidence"),
    )


@query("change_summary", ("doc_pairs",), VERDICT_SQL + """
SELECT pair_id, CASE WHEN NOT has_changed THEN 'No significant changes detected' ELSE concat('Changes detected: ', replace(change_type, ',', ', '),
  CASE WHEN similarity_score < 0.5 THEN '. Major content differences' WHEN similarity_score < 0.8 THEN '. Moderate content differences' ELSE '. Minor content differences' END,
  '. Risk level: ', risk_level) END AS change_summary FROM verdict
""")
def change_summary(t):
    return changes.change_summary(verdicts(t)).select("pair_id", "change_summary")


@query("significant_change", ("doc_pairs",), f"""
, v AS (SELECT *, {_side('old')}, {_side('new')} FROM doc_pairs),
s AS (SELECT *, CAST({_KS} AS DOUBLE) AS sim, coalesce(CASE WHEN old_structure_hash = new_structure_hash THEN 1.0 END, 0.0) AS st,
  coalesce(old_title, '') <> coalesce(new_title, '') AS tc FROM v)
SELECT pair_id, round(sim, 6) AS content_similarity, CAST(st AS DOUBLE) AS structure_similarity, tc AS title_changed, sim < 0.7 OR st < 0.5 OR tc AS significant_change,
  array_to_string(list_filter([CASE WHEN tc THEN 'Title changed' END, CASE WHEN sim < 0.7 THEN 'Content similarity: ' || format('{{:.2f}}', sim) END,
    CASE WHEN st < 0.5 THEN 'DOM structure changed' END, CASE WHEN abs(coalesce(old_word_count, 0) - coalesce(new_word_count, 0)) > 50
    THEN concat('Word count changed: ', coalesce(old_word_count, 0), ' → ', coalesce(new_word_count, 0)) END], lambda x: x IS NOT NULL), '; ') AS change_summary FROM s
""")
def significant_change(t):
    out = changes.significant_change(versions(t, "text", "title", "word_count", "structure_hash"))
    return out.select(
        "pair_id", F.round("content_similarity", 6).alias("content_similarity"), "structure_similarity",
        "title_changed", "significant_change", F.array_join("change_summary", "; ").alias("change_summary"),
    )
