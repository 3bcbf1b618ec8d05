"""Queries over the threat rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.functions import text
from driftwatch.functions.threat_rules import RULES, SUSPICIOUS_KEYWORDS, THREAT_CATEGORIES
from driftwatch.operators import classify, ensemble, rules
from driftwatch.operators.verdicts import parse_verdicts
from driftwatch.plans import sqltext as q
from driftwatch.plans.metrics_queries import rounded
from driftwatch.plans.registry import query
from driftwatch.plans.text_queries import PARSED_SQL


def hits_sql(source: str, key: str, column: str = "text", categories=None) -> str:
    """Rows (key, text, hits) where hits lists the indexes of matching rules."""
    tests = ",\n".join(
        f"CASE WHEN regexp_matches({column}, {q.lit(q.re2(r.pattern))}) THEN {r.index} END"
        for r in RULES
        if categories is None or r.category in categories
    )
    return f"(SELECT {key}, {column}, list_filter([{tests}], lambda x: x IS NOT NULL) AS hits FROM {source})"


def table_sql() -> str:
    rows = ",\n".join(
        f"({r.index}, {q.lit(r.category)}, {r.rule_no}, CAST({r.score} AS DOUBLE), {q.lit(r.label)})" for r in RULES
    )
    return f"rl(idx, category, rule_no, score, label) AS (VALUES {rows})"


def matches_sql(source: str, key: str, column: str, categories=None) -> str:
    counts = "\n".join(
        f"WHEN {r.index} THEN len(regexp_extract_all({column}, {q.lit(q.re2(r.pattern))}, 0))"
        for r in RULES
        if categories is None or r.category in categories
    )
    return f""", {table_sql()}, h AS {hits_sql(source, key, column, categories)},
x AS (SELECT {key}, {column}, unnest(hits) AS i FROM h)
SELECT {key}, category, rule_no, score, label, CAST(CASE i {counts} END AS INT) AS match_count FROM x JOIN rl ON idx = i"""


for _category in (*THREAT_CATEGORIES, "benign"):
    _name = f"rules_{_category}"
    if _category == "xss":

        @query(_name, ("pages_injected",), matches_sql("pages_injected", "page_id", "html", (_category,)))
        def page_rules(t, category=_category):
            return rules.rule_matches(t.pages_injected, "page_id", "html", (category,))

    else:

        @query(_name, ("docs_planted",), matches_sql("docs_planted", "doc_id", "text", (_category,)))
        def document_rules(t, category=_category):
            return rules.rule_matches(t.docs_planted, "doc_id", "text", (category,))


@query("rule_matches", ("docs_planted",), matches_sql("docs_planted", "doc_id", "text"))
def rule_matches(t):
    return rules.rule_matches(t.docs_planted, "doc_id")


@query("rule_matches_pages", ("pages_injected",), matches_sql("pages_injected", "page_id", "html"))
def rule_matches_pages(t):
    return rules.rule_matches(t.pages_injected, "page_id", "html")


_SUMS = ",\n".join(
    f"round(coalesce(list_sum(list_transform(list_filter(hits, lambda i: i >= {min(r.index for r in RULES if r.category == c)} "
    f"AND i <= {max(r.index for r in RULES if r.category == c)}), lambda i: scores[i])), 0), 9) AS {c}_score"
    for c in (*THREAT_CATEGORIES, "benign")
)
_TOP = "greatest(" + ", ".join(f"{c}_score" for c in THREAT_CATEGORIES) + ")"
_LEAD = " ".join(f"WHEN {c}_score = {_TOP} THEN '{c}'" for c in THREAT_CATEGORIES)
_PRESENT = ", ".join(f"CASE WHEN {c}_score > 0 THEN '{c}' END" for c in THREAT_CATEGORIES)

VERDICT_SQL = f"""
, k AS (SELECT [{", ".join(f"CAST({r.score} AS DOUBLE)" for r in RULES)}] AS scores, [{", ".join(q.lit(r.label) for r in RULES)}] AS labels),
h AS {hits_sql("docs_planted", "doc_id")},
s AS (SELECT doc_id, text, hits, labels, {_SUMS} FROM h, k),
v1 AS (SELECT *, round({" + ".join(f"{c}_score" for c in (*THREAT_CATEGORIES, "benign"))}, 9) AS total_score, CASE WHEN {_TOP} <= 0 THEN 'unknown' {_LEAD} END AS threat_category,
  list_filter([{_PRESENT}], lambda x: x IS NOT NULL) AS categories FROM s),
v2 AS (SELECT *, least(1.0, $RAW) AS c, list_transform(hits, lambda i: labels[i]) AS triggered FROM v1),
v3 AS (SELECT *, CASE WHEN c >= 0.7 THEN 'defacement' WHEN c >= 0.4 THEN 'unclear' ELSE 'benign' END AS rule_label,
  CAST(CASE WHEN len(categories) > 2 THEN least(1.0, c * 1.2) ELSE c END AS DOUBLE) AS rule_confidence FROM v2)
"""
CLAMPED = VERDICT_SQL.replace("$RAW", "greatest(0.0, total_score)")


@query("rule_scores", ("docs_planted",), CLAMPED + f"""
SELECT doc_id, {", ".join(f"round({c}_score, 6) AS {c}_score" for c in (*THREAT_CATEGORIES, "benign"))}, round(total_score, 6) AS total_score, threat_category,
  array_to_string(categories, ',') AS categories FROM v3""")
def rule_scores(t):
    out = rules.rule_scores(rules.rule_hits(t.docs_planted.select("doc_id", "text"))).drop("text", "hits")
    numbers = [f"{c}_score" for c in (*THREAT_CATEGORIES, "benign")] + ["total_score"]
    return rounded(out, *numbers).withColumn("categories", F.array_join("categories", ","))


def verdict(t, as_coded=False):
    scored = rules.rule_scores(rules.rule_hits(t.docs_planted.select("doc_id", "text")))
    return rules.rule_verdict(scored, as_coded)


_VERDICT_OUT = "SELECT doc_id, rule_label, round(rule_confidence, 6) AS rule_confidence, threat_category, array_to_string(triggered, ' ; ') AS triggered_rules FROM v3"


@query("rule_verdict", ("docs_planted",), CLAMPED + _VERDICT_OUT)
def rule_verdict(t):
    out = rounded(verdict(t), "rule_confidence")
    return out.select("doc_id", "rule_label", "rule_confidence", "threat_category", F.array_join("triggered_rules", " ; ").alias("triggered_rules"))


@query("rule_verdict_ascoded", ("docs_planted",), VERDICT_SQL.replace("$RAW", "abs(total_score)") + _VERDICT_OUT)
def rule_verdict_ascoded(t):
    out = rounded(verdict(t, as_coded=True), "rule_confidence")
    return out.select("doc_id", "rule_label", "rule_confidence", "threat_category", F.array_join("triggered_rules", " ; ").alias("triggered_rules"))


@query("rule_reasoning", ("docs_planted",), CLAMPED + """
SELECT doc_id, concat_ws('. ', CASE WHEN rule_confidence >= 0.8 THEN 'High confidence threat detected' WHEN rule_confidence >= 0.5 THEN 'Moderate confidence threat detected'
    ELSE 'Low confidence assessment' END || ' (' || format('{:.2f}', rule_confidence) || ')',
  CASE WHEN threat_category <> 'unknown' THEN 'Primary threat type: ' || threat_category END,
  CASE WHEN len(categories) > 1 THEN 'Multiple threat indicators detected: ' || array_to_string(categories, ', ') END,
  CASE WHEN len(triggered) > 0 THEN 'Key indicators: ' || array_to_string(triggered, ', ') END,
  CASE WHEN rule_confidence >= 0.9 THEN 'CRITICAL: Immediate action required' WHEN rule_confidence >= 0.7 THEN 'HIGH: Prompt investigation needed'
    WHEN rule_confidence >= 0.5 THEN 'MEDIUM: Review recommended' END) AS rule_reasoning FROM v3""")
def rule_reasoning(t):
    return rules.rule_reasoning(verdict(t)).select("doc_id", "rule_reasoning")


_FOUND = "\n".join(
    f"WHEN {r.index} THEN regexp_extract_all(text, {q.lit(q.re2(r.pattern))}, 0)" for r in RULES if r.category != "benign"
)
INDICATOR_SQL = f"""
, {table_sql()}, h AS {hits_sql("docs_planted", "doc_id", "text", THREAT_CATEGORIES)},
x AS (SELECT doc_id, text, unnest(hits) AS i FROM h),
y AS (SELECT doc_id, text, i, CASE i {_FOUND} END AS ms FROM x),
z AS (SELECT doc_id, text, i, unnest(ms) AS matched_text, unnest(range(1, len(ms) + 1)) AS n FROM y),
ind AS (SELECT doc_id, text, i, n, matched_text FROM z)
"""


def indicators(t):
    hit = rules.rule_hits(t.docs_planted.select("doc_id", "text"), categories=THREAT_CATEGORIES)
    return rules.threat_indicators(hit)


@query("threat_indicators", ("docs_planted",), INDICATOR_SQL + """
SELECT doc_id, category, rule_no, score, n AS match_no, matched_text FROM ind JOIN rl ON idx = i""")
def threat_indicators(t):
    listed = indicators(t).select("doc_id", "indicators", F.posexplode_outer("indicators").alias("_p", "m")).filter("m IS NOT NULL")

    def same_rule_so_far(other, p):
        return (p <= F.col("_p")) & (other["category"] == F.col("m.category")) & (other["rule_no"] == F.col("m.rule_no"))

    number = F.size(F.filter("indicators", same_rule_so_far)).cast("long")
    return listed.select("doc_id", "m.category", "m.rule_no", "m.score", number.alias("match_no"), "m.matched_text")


@query("match_context", ("docs_planted",), INDICATOR_SQL + """
SELECT DISTINCT doc_id, category, rule_no, matched_text, CASE WHEN p > 51 THEN '...' ELSE '' END || substr(text, greatest(p - 50, 1), least(p + length(matched_text) + 49, length(text)) - greatest(p - 50, 1) + 1)
  || CASE WHEN p + length(matched_text) + 49 < length(text) THEN '...' ELSE '' END AS context
FROM (SELECT *, instr(text, matched_text) AS p FROM ind) z JOIN rl ON idx = i""")
def match_context(t):
    rows = indicators(t).select("doc_id", "text", F.explode_outer("indicators").alias("m")).filter("m IS NOT NULL")
    context = rules.match_context(F.col("text"), F.col("m.matched_text"))
    return rows.select("doc_id", "m.category", "m.rule_no", "m.matched_text", context.alias("context")).distinct()


@query("suspicious_keywords", ("docs_planted",), f"""
SELECT doc_id, pattern, 'high' AS risk_level FROM docs_planted, (VALUES {", ".join(f"('{w}')" for w in SUSPICIOUS_KEYWORDS)}) v(pattern) WHERE contains(lower(text), pattern)
""")
def suspicious_keywords(t):
    return rules.suspicious_keywords(t.docs_planted, "doc_id")


URLS = r"""https?://[^\s<>"''{}|\\^`\[\]]*"""


@query("external_resources", ("docs_planted", "pages_injected"), f"""
SELECT DISTINCT 'doc' AS kind, doc_id AS id, unnest(regexp_extract_all(text, '{URLS}', 0)) AS url FROM docs_planted
UNION ALL SELECT DISTINCT 'page', page_id, unnest(regexp_extract_all(html, '{URLS}', 0)) FROM pages_injected
""")
def external_resources(t):
    docs = t.docs_planted.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.explode(text.external_resources(F.col("text"))).alias("url"))
    pages = t.pages_injected.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.explode(text.external_resources(F.col("html"))).alias("url"))
    return docs.unionByName(pages)


@query("resource_anomaly", ("docs_planted",), f"""
, u AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '{URLS}', 0)) AS urls FROM docs_planted)
SELECT doc_id, len(list_filter(urls, lambda u: regexp_matches(lower(u), '\\.tk|\\.ml|\\.ga|\\.cf|bit\\.ly|tinyurl\\.com'))) > 2 AS unusual_external_resources FROM u
""")
def resource_anomaly(t):
    docs = t.docs_planted.select("doc_id", text.external_resources(F.col("text")).alias("external_resources"))
    return ensemble.resource_anomaly(docs).drop("external_resources")


def _cases(column: str, table: dict, default: float) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items())
    return f"CAST(CASE {column} {arms} ELSE {default} END AS DOUBLE)"


CLASSIFY_SQL = CLAMPED + INDICATOR_SQL.replace(" h AS ", " hh AS ").replace("FROM h)", "FROM hh)") + PARSED_SQL + f"""
, ic AS (SELECT doc_id, count(DISTINCT category) AS cats, count(*) FILTER (score > 0.8) AS hi FROM ind JOIN rl ON idx = i GROUP BY 1),
bh AS (SELECT doc_id, CAST(CASE WHEN len(list_filter(list_distinct(regexp_extract_all(text, '{URLS}', 0)), lambda u: regexp_matches(lower(u), '\\.tk|\\.ml|\\.ga|\\.cf|bit\\.ly|tinyurl\\.com'))) > 2 THEN 0.6 ELSE 0 END
  + CASE WHEN doc_id % 10 < 3 THEN 0.8 ELSE 0 END + CASE WHEN doc_id % 6 = 0 THEN 0.7 ELSE 0 END AS DOUBLE) AS b FROM docs_planted),
c1 AS (SELECT v3.doc_id, v3.rule_label, v3.rule_confidence, v3.threat_category, coalesce(cats, 0) AS cats, coalesce(hi, 0) AS hi, least(1.0, b) AS beh, b, p.label AS llm_label, CAST(p.confidence AS DOUBLE) AS llm_confidence, e.semantic_risk,
  CASE WHEN v3.doc_id % 10 <> 0 THEN CAST(v3.doc_id % 9 AS DOUBLE) / 8 END AS sim
  FROM v3 JOIN bh ON bh.doc_id = v3.doc_id JOIN parsed p ON p.doc_id = v3.doc_id JOIN ensemble e ON e.doc_id = v3.doc_id LEFT JOIN ic ON ic.doc_id = v3.doc_id),
c2 AS (SELECT *, CAST(least(1.0, cats / 3) AS DOUBLE) AS cov, CAST(coalesce(1 - sim, 0) AS DOUBLE) AS drift, CAST(CASE WHEN llm_label = rule_label THEN 1 ELSE 0.5 END AS DOUBLE) AS xv FROM c1),
c3 AS (SELECT *, round(least(CAST(1 AS DOUBLE), (0.2::DOUBLE * rule_confidence + 0.2::DOUBLE * cov + 0.15::DOUBLE * drift + 0.15::DOUBLE * beh + 0.1::DOUBLE * llm_confidence + 0.07::DOUBLE + 0.1::DOUBLE * xv)
  * {_cases('threat_category', ensemble.CATEGORY_WEIGHTS, 0.5)} * CASE WHEN (rule_confidence > 0.7)::INT + (cov > 0.7)::INT + (drift > 0.7)::INT + (beh > 0.7)::INT + (llm_confidence > 0.7)::INT + (xv > 0.7)::INT >= 3 THEN 1.2::DOUBLE ELSE 1::DOUBLE END), 9) AS conf,
  CASE WHEN b >= 0.8 THEN 'critical' WHEN b >= 0.6 THEN 'high' WHEN b >= 0.4 THEN 'medium' WHEN b >= 0.2 THEN 'low' ELSE 'minimal' END AS behavior_risk FROM c2),
vt AS (SELECT doc_id, llm_label AS l, llm_confidence * 0.2::DOUBLE AS w FROM c3 UNION ALL SELECT doc_id, rule_label, rule_confidence * CASE WHEN rule_confidence > 0.8 THEN 0.45::DOUBLE ELSE 0.3::DOUBLE END FROM c3
  UNION ALL SELECT doc_id, CASE WHEN semantic_risk IN ('high', 'critical') THEN 'defacement' WHEN semantic_risk = 'low' THEN 'benign' ELSE 'unclear' END, CASE WHEN semantic_risk = 'medium' THEN 0.14::DOUBLE ELSE 0.18::DOUBLE END FROM c3
  UNION ALL SELECT doc_id, CASE WHEN behavior_risk IN ('high', 'critical') THEN 'defacement' WHEN behavior_risk = 'low' THEN 'benign' ELSE 'unclear' END, CASE WHEN behavior_risk IN ('high', 'critical', 'low') THEN 0.12::DOUBLE ELSE 0.09::DOUBLE END FROM c3),
vs AS (SELECT doc_id, arg_max(l, round(w, 9) * 10 - CASE l WHEN 'benign' THEN 0 WHEN 'defacement' THEN 1e-9 ELSE 2e-9 END) AS final_label FROM (SELECT doc_id, l, sum(w) AS w FROM vt GROUP BY 1, 2) z GROUP BY 1)
SELECT c3.doc_id, final_label, round(conf, 8) AS confidence_score, CASE WHEN conf >= 0.95 THEN 'critical' WHEN conf >= 0.8 THEN 'very_high' WHEN conf >= 0.6 THEN 'high' WHEN conf >= 0.4 THEN 'medium' WHEN conf >= 0.2 THEN 'low' ELSE 'very_low' END AS confidence_level,
  threat_category, round(least(1.0, CASE WHEN hi > 3 THEN least(1.0, {_cases('threat_category', ensemble.BASE_SEVERITY, 0.5)} * 1.2::DOUBLE) ELSE {_cases('threat_category', ensemble.BASE_SEVERITY, 0.5)} END * conf), 8) AS severity_score,
  rule_label, llm_label, behavior_risk FROM c3 JOIN vs ON vs.doc_id = c3.doc_id
"""


@query("classify_snapshots", ("docs_planted", "verdicts", "ensemble"), CLASSIFY_SQL)
def classify_snapshots(t):
    doc = F.col("doc_id")
    changed = t.docs_planted.select(
        "doc_id", "text",
        F.lit(100).alias("old_element_count"), F.when(doc % 6 == 0, 40).otherwise(100).alias("new_element_count"),
        ((doc % 10).cast("double") / 10).alias("content_similarity"),
    )
    semantics = t.ensemble.select("doc_id", "semantic_risk", F.when(doc % 10 != 0, (doc % 9).cast("double") / 8).alias("main_similarity"))
    out = classify.classify_snapshots(changed, parse_verdicts(t.verdicts), semantics, key="doc_id")
    kept = out.select(
        "doc_id", "final_label", "confidence_score", "confidence_level", "threat_category", "severity_score", "rule_label",
        "llm_label", "behavior_risk",
    )
    return rounded(kept, "confidence_score", "severity_score", digits=8)
