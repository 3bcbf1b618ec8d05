"""Queries over per-classifier results."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.operators import ensemble
from driftwatch.plans.metrics_queries import rounded
from driftwatch.plans.registry import query


def results(t):
    """Per-classifier results with the supporting measures of each document."""
    doc = F.col("doc_id")
    marks = F.array(
        F.struct(F.col("threat_category").alias("category"), F.concat(F.lit("match number "), doc.cast("string")).alias("matched_text")),
        F.struct(F.lit("xss").alias("category"), F.lit("a rather long matched text of some forty characters").alias("matched_text")),
    )
    return t.ensemble.withColumns(
        {
            "category_count": (doc % 4).cast("int"),
            "main_similarity": F.when(doc % 10 != 0, (doc % 9).cast("double") / 8),
            "behavior_score": (doc % 6).cast("double") / 5,
            "high_indicators": (doc % 6).cast("int"),
            "indicators": F.when(F.col("rule_label") != "benign", marks).otherwise(F.slice(marks, 1, 0)),
            "anomalies": F.when(doc % 2 == 0, F.array(F.lit("unusual_external_resources"), F.lit("mass_element_deletion"))).otherwise(
                F.array().cast("array<string>")
            ),
        }
    )


CW = "CASE threat_category WHEN 'defacement' THEN 1.0 WHEN 'backdoor' THEN 1.0 WHEN 'xss' THEN 0.85 WHEN 'phishing' THEN 0.9 ELSE 0.5 END"
BS = "CASE threat_category WHEN 'defacement' THEN 0.8 WHEN 'backdoor' THEN 1.0 WHEN 'xss' THEN 0.6 WHEN 'phishing' THEN 0.8 ELSE 0.5 END"


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


ENSEMBLE_SQL = f"""
, e1 AS (SELECT *, rule_confidence AS rms, {_d("least(1.0, (doc_id % 4) / 3)")} AS cov, {_d("CASE WHEN doc_id % 10 <> 0 THEN 1 - CAST(doc_id % 9 AS DOUBLE) / 8 ELSE 0 END")} AS drift,
  CAST(doc_id % 6 AS DOUBLE) / 5 AS beh, llm_confidence AS ai, {_d("0.7")} AS hist, {_d("CASE WHEN llm_label = rule_label THEN 1 ELSE 0.5 END")} AS xv, doc_id % 6 AS hi FROM ensemble),
e2 AS (SELECT *, {_d("0.2")} * rms + {_d("0.2")} * cov + {_d("0.15")} * drift + {_d("0.15")} * beh + {_d("0.1")} * ai + {_d("0.1")} * hist + {_d("0.1")} * xv AS raw,
  CAST((rms > 0.7)::INT + (cov > 0.7)::INT + (drift > 0.7)::INT + (beh > 0.7)::INT + (ai > 0.7)::INT + (hist > CAST(0.7 AS DOUBLE))::INT + (xv > 0.7)::INT AS INT) AS strong FROM e1),
e3 AS (SELECT *, round(least(CAST(1 AS DOUBLE), raw * {_d(CW)} * {_d("CASE WHEN strong >= 3 THEN 1.2 ELSE 1 END")}), 9) AS conf,
  CASE WHEN llm_label = rule_label THEN least(1.0, (llm_confidence + rule_confidence) / 2 + {_d("0.2")}) ELSE greatest({_d("0.1")}, (llm_confidence + rule_confidence) / 4) END AS agr,
  CASE WHEN semantic_risk IN ('high', 'critical') THEN 'defacement' WHEN semantic_risk = 'low' THEN 'benign' ELSE 'unclear' END AS sl,
  {_d("CASE WHEN semantic_risk IN ('high', 'critical', 'low') THEN 0.18 ELSE 0.14 END")} AS sv,
  CASE WHEN behavior_risk IN ('high', 'critical') THEN 'defacement' WHEN behavior_risk = 'low' THEN 'benign' ELSE 'unclear' END AS bl,
  {_d("CASE WHEN behavior_risk IN ('high', 'critical', 'low') THEN 0.12 ELSE 0.09 END")} AS bv,
  llm_confidence * {_d("0.2")} AS lv, rule_confidence * {_d("CASE WHEN rule_confidence > 0.8 THEN 0.45 ELSE 0.3 END")} AS rv FROM e2),
e4 AS (SELECT *, {", ".join(f"round(" + " + ".join(f"CASE WHEN {label} = '{v}' THEN {w} ELSE 0 END" for label, w in (('llm_label','lv'),('rule_label','rv'),('sl','sv'),('bl','bv'))) + f", 9) AS {v}_votes" for v in ("benign", "defacement", "unclear"))},
  CASE WHEN conf >= 0.95 THEN 'critical' WHEN conf >= 0.8 THEN 'very_high' WHEN conf >= 0.6 THEN 'high' WHEN conf >= 0.4 THEN 'medium' WHEN conf >= 0.2 THEN 'low' ELSE 'very_low' END AS lvl FROM e3),
e5 AS (SELECT *, CASE WHEN benign_votes >= defacement_votes AND benign_votes >= unclear_votes THEN 'benign' WHEN defacement_votes >= unclear_votes THEN 'defacement' ELSE 'unclear' END AS final_label,
  least(1.0, CASE WHEN hi > 3 THEN least(1.0, {_d(BS)} * {_d("1.2")}) ELSE {_d(BS)} END * conf) AS sev FROM e4)
"""


@query("confidence_factors", ("ensemble",), ENSEMBLE_SQL + """
SELECT doc_id, round(rms, 6) AS rule_match_strength, round(cov, 6) AS pattern_coverage, round(drift, 6) AS semantic_drift, round(beh, 6) AS behavioral_anomaly,
  round(ai, 6) AS ai_certainty, hist AS historical_accuracy, xv AS cross_validation FROM e5""")
def confidence_factors(t):
    names = list(ensemble.FACTOR_WEIGHTS)
    return rounded(ensemble.confidence_factors(results(t)).select("doc_id", *names), *names)


def scored(t):
    return ensemble.confidence_score(ensemble.confidence_factors(results(t)))


@query("confidence_score", ("ensemble",), ENSEMBLE_SQL + "SELECT doc_id, strong AS strong_factors, round(conf, 8) AS confidence_score FROM e5")
def confidence_score(t):
    return rounded(scored(t).select("doc_id", "strong_factors", "confidence_score"), "confidence_score", digits=8)


@query("classifier_agreement", ("ensemble",), ENSEMBLE_SQL + "SELECT doc_id, round(CAST(agr AS DOUBLE), 6) AS agreement FROM e5")
def classifier_agreement(t):
    return rounded(ensemble.classifier_agreement(results(t)).select("doc_id", "agreement"), "agreement")


@query("confidence_level", ("ensemble",), ENSEMBLE_SQL + "SELECT doc_id, lvl AS confidence_level FROM e5")
def confidence_level(t):
    return ensemble.confidence_level(scored(t)).select("doc_id", "confidence_level")


@query("weighted_vote", ("ensemble",), ENSEMBLE_SQL + """
SELECT doc_id, round(benign_votes, 6) AS benign_votes, round(defacement_votes, 6) AS defacement_votes, round(unclear_votes, 6) AS unclear_votes, final_label FROM e5""")
def weighted_vote(t):
    names = ["benign_votes", "defacement_votes", "unclear_votes"]
    return rounded(ensemble.weighted_vote(results(t)).select("doc_id", *names, "final_label"), *names)


@query("severity_score", ("ensemble",), ENSEMBLE_SQL + "SELECT doc_id, round(CAST(sev AS DOUBLE), 8) AS severity_score FROM e5")
def severity_score(t):
    return rounded(ensemble.severity_score(scored(t)).select("doc_id", "severity_score"), "severity_score", digits=8)


def judged(t):
    return ensemble.combine(results(t))


@query("response_actions", ("ensemble",), ENSEMBLE_SQL + """
SELECT doc_id, concat(CASE final_label WHEN 'defacement' THEN 'immediately_block_traffic,trigger_backup_restore,notify_security_team,create_incident_ticket,preserve_forensic_evidence'
  WHEN 'unclear' THEN 'flag_for_manual_review,increase_monitoring_frequency,collect_additional_evidence' ELSE 'update_baseline,log_normal_activity' END,
  CASE WHEN lvl IN ('critical', 'very_high') THEN ',escalate_to_senior_analyst,initiate_emergency_response' ELSE '' END,
  CASE threat_category WHEN 'backdoor' THEN ',full_system_scan,access_log_analysis' WHEN 'phishing' THEN ',domain_takedown_request,user_warning' ELSE '' END) AS recommended_actions FROM e5""")
def response_actions(t):
    return judged(t).select("doc_id", F.array_join("recommended_actions", ",").alias("recommended_actions"))


@query("verdict_reasoning", ("ensemble",), ENSEMBLE_SQL + """
SELECT doc_id, concat_ws(' | ', 'Classification: ' || final_label || ' (confidence: ' || format('{:.2f}', conf) || ')', 'Primary threat type: ' || threat_category,
  'AI analysis (weight: 0.20): ' || llm_label || ' (' || format('{:.2f}', llm_confidence) || ')',
  'Rule-based detection (weight: 0.30): ' || rule_label || ' (' || format('{:.2f}', rule_confidence) || ')',
  CASE WHEN rule_label <> 'benign' THEN 'Key indicators: ' || threat_category || ': match number ' || doc_id || '..., xss: a rather long matched text of ...' END,
  'Semantic analysis (weight: 0.20): risk level ' || semantic_risk,
  CASE WHEN doc_id % 2 = 0 THEN 'Behavioral anomalies detected: unusual_external_resources, mass_element_deletion' END) AS reasoning FROM e5""")
def verdict_reasoning(t):
    return judged(t).select("doc_id", "reasoning")


@query("structure_anomaly", ("doc_pairs",), """
, p AS (SELECT pair_id, length(old_text) // 10 AS o, length(new_text) // 10 AS n, (pair_id % 10) / 10 AS s FROM doc_pairs WHERE old_text IS NOT NULL)
SELECT pair_id, CASE WHEN o > 0 THEN 1 - n / o > 0.5 END AS mass_element_deletion, s < 0.3 AS sudden_content_replacement FROM p
""")
def structure_anomaly(t):
    pairs = t.doc_pairs.filter(F.col("old_text").isNotNull()).select(
        "pair_id",
        F.floor(F.length("old_text") / 10).alias("old_element_count"),
        F.floor(F.length("new_text") / 10).alias("new_element_count"),
        ((F.col("pair_id") % 10).cast("double") / 10).alias("content_similarity"),
    )
    out = ensemble.structure_anomaly(pairs)
    return out.select("pair_id", "mass_element_deletion", "sudden_content_replacement")


@query("behavior_score", ("doc_pairs",), """
, p AS (SELECT pair_id, coalesce(length(old_text) // 10 > 0 AND 1 - (length(new_text) // 10) / (length(old_text) // 10) > 0.5, false) AS m, (pair_id % 10) / 10 < 0.3 AS r, pair_id % 4 = 0 AS u FROM doc_pairs WHERE old_text IS NOT NULL),
s AS (SELECT *, CAST((CASE WHEN r THEN 0.8 ELSE 0 END + CASE WHEN m THEN 0.7 ELSE 0 END + CASE WHEN u THEN 0.6 ELSE 0 END) AS DOUBLE) AS x FROM p)
SELECT pair_id, round(least(1.0, x), 6) AS behavior_score, CASE WHEN x >= 0.8 THEN 'critical' WHEN x >= 0.6 THEN 'high' WHEN x >= 0.4 THEN 'medium' WHEN x >= 0.2 THEN 'low' ELSE 'minimal' END AS behavior_risk,
  array_to_string(list_filter([CASE WHEN r THEN 'sudden_content_replacement' END, CASE WHEN m THEN 'mass_element_deletion' END, CASE WHEN u THEN 'unusual_external_resources' END], lambda x: x IS NOT NULL), ',') AS anomalies FROM s
""")
def behavior_score(t):
    pairs = t.doc_pairs.filter(F.col("old_text").isNotNull()).select(
        "pair_id",
        F.floor(F.length("old_text") / 10).alias("old_element_count"),
        F.floor(F.length("new_text") / 10).alias("new_element_count"),
        ((F.col("pair_id") % 10).cast("double") / 10).alias("content_similarity"),
        (F.col("pair_id") % 4 == 0).alias("unusual_external_resources"),
    )
    out = ensemble.behavior_score(ensemble.structure_anomaly(pairs))
    return rounded(out.select("pair_id", "behavior_score", "behavior_risk", F.array_join("anomalies", ",").alias("anomalies")), "behavior_score")
