"""Behaviour signals and the combination of classifier results into one verdict.

Every function adds columns row by row; nothing here shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.text import fixed

# Anomaly weights.
ANOMALY_WEIGHTS = {
    "sudden_content_replacement": 0.8,
    "mass_element_deletion": 0.7,
    "suspicious_script_injection": 0.85,
    "unusual_external_resources": 0.6,
    "abnormal_update_frequency": 0.5,
    "performance_degradation": 0.4,
}

# Hosts that make an external resource suspicious.
SUSPICIOUS_HOSTS = (".tk", ".ml", ".ga", ".cf", "bit.ly", "tinyurl.com")

# Confidence factor weights.
FACTOR_WEIGHTS = {
    "rule_match_strength": 0.20,
    "pattern_coverage": 0.20,
    "semantic_drift": 0.15,
    "behavioral_anomaly": 0.15,
    "ai_certainty": 0.10,
    "historical_accuracy": 0.10,
    "cross_validation": 0.10,
}

# Confidence multiplier per threat category (0.5 for others).
CATEGORY_WEIGHTS = {
    "defacement": 1.0, "backdoor": 1.0, "cryptojacking": 0.9, "sql_injection": 0.95,
    "xss": 0.85, "phishing": 0.9, "malware": 0.95, "unknown": 0.5,
}

# Base severity per threat category (0.5 for others).
BASE_SEVERITY = {
    "defacement": 0.8, "backdoor": 1.0, "cryptojacking": 0.7, "sql_injection": 0.9,
    "xss": 0.6, "phishing": 0.8, "malware": 0.9, "unknown": 0.5,
}

# Voting weight per classifier.
VOTE_WEIGHTS = {"llm": 0.20, "rule_based": 0.30, "semantic": 0.20, "behavioral": 0.15, "pattern_match": 0.15}

# Response actions per verdict, per threat category, and for sure verdicts.
RESPONSE_ACTIONS = {
    "defacement": (
        "immediately_block_traffic", "trigger_backup_restore", "notify_security_team",
        "create_incident_ticket", "preserve_forensic_evidence",
    ),
    "unclear": ("flag_for_manual_review", "increase_monitoring_frequency", "collect_additional_evidence"),
    "benign": ("update_baseline", "log_normal_activity"),
}
CATEGORY_ACTIONS = {
    "backdoor": ("full_system_scan", "access_log_analysis"),
    "cryptojacking": ("block_mining_pools", "cpu_monitoring"),
    "phishing": ("domain_takedown_request", "user_warning"),
    "sql_injection": ("database_audit", "query_log_review"),
}
SURE_ACTIONS = ("escalate_to_senior_analyst", "initiate_emergency_response")
SURE_LEVELS = ("critical", "very_high")


def lookup(key: Column, table: dict, default) -> Column:
    """A small constant table as a CASE expression."""
    out = reduce(lambda c, kv: c.when(key == kv[0], _value(kv[1])), table.items(), F.when(F.lit(False), _value(default)))
    return out.otherwise(_value(default))


def _value(value) -> Column:
    if isinstance(value, tuple):
        return F.array(*map(F.lit, value)) if value else F.array().cast("array<string>")
    return F.lit(value)


def structure_anomaly(df: DataFrame) -> DataFrame:
    """Adds deletion and replacement flags from element counts and similarity.

    No previous element count means the deletion check does not apply (null).
    """
    ratio = 1 - F.col("new_element_count") / F.col("old_element_count")
    return df.withColumns(
        {
            "mass_element_deletion": F.when(F.col("old_element_count") > 0, ratio > 0.5),
            "sudden_content_replacement": F.coalesce(F.col("content_similarity"), F.lit(1.0)) < 0.3,
        }
    )


def resource_anomaly(df: DataFrame, resources: str = "external_resources") -> DataFrame:
    """Adds ``unusual_external_resources``: more than two suspicious addresses."""

    def suspicious(url: Column) -> Column:
        hits = [F.contains(F.lower(url), F.lit(h)) for h in SUSPICIOUS_HOSTS]
        return reduce(lambda a, b: a | b, hits)

    return df.withColumn("unusual_external_resources", F.size(F.filter(resources, suspicious)) > 2)


def behavior_score(df: DataFrame) -> DataFrame:
    """Adds ``behavior_score``, ``behavior_risk`` and ``anomalies`` from the flags present."""
    present = [name for name in ANOMALY_WEIGHTS if name in df.columns]
    flags = {name: F.coalesce(F.col(name), F.lit(False)) for name in present}
    total = reduce(lambda a, b: a + b, [F.when(f, ANOMALY_WEIGHTS[n]).otherwise(0.0) for n, f in flags.items()])
    risk = (
        F.when(F.col("_total") >= 0.8, "critical")
        .when(F.col("_total") >= 0.6, "high")
        .when(F.col("_total") >= 0.4, "medium")
        .when(F.col("_total") >= 0.2, "low")
        .otherwise("minimal")
    )
    named = F.array_compact(F.array(*[F.when(f, n) for n, f in flags.items()]))
    return (
        df.withColumn("_total", total)
        .withColumns(
            {"behavior_score": F.least(F.lit(1.0), F.col("_total")), "behavior_risk": risk, "anomalies": named}
        )
        .drop("_total")
    )


def confidence_factors(df: DataFrame) -> DataFrame:
    """Adds the seven confidence factors, each between 0 and 1."""
    labels = F.array_distinct(F.array_compact(F.array("llm_label", "rule_label")))
    return df.withColumns(
        {
            "rule_match_strength": F.coalesce("rule_confidence", F.lit(0.0)),
            "pattern_coverage": F.least(F.lit(1.0), F.coalesce("category_count", F.lit(0)) / 3),
            "semantic_drift": F.coalesce(1.0 - F.col("main_similarity"), F.lit(0.0)),
            "behavioral_anomaly": F.coalesce("behavior_score", F.lit(0.0)),
            "ai_certainty": F.coalesce("llm_confidence", F.lit(0.0)),
            "historical_accuracy": F.lit(0.7),
            "cross_validation": F.when(F.size(labels) == 1, 1.0).otherwise(0.5),
        }
    )


def confidence_score(df: DataFrame) -> DataFrame:
    """Adds ``strong_factors`` and ``confidence_score`` from the factors.

    The score is rounded to 9 digits so that levels do not hang on float noise.
    """
    weighted = reduce(lambda a, b: a + b, [F.col(n) * w for n, w in FACTOR_WEIGHTS.items()])
    strong = reduce(lambda a, b: a + b, [(F.col(n) > 0.7).cast("int") for n in FACTOR_WEIGHTS])
    category = F.when(
        F.col("rule_label").isNotNull(), lookup(F.col("threat_category"), CATEGORY_WEIGHTS, 0.5)
    ).otherwise(1.0)
    return (
        df.withColumns({"strong_factors": strong, "_score": weighted * category})
        .withColumn(
            "confidence_score",
            F.round(
                F.least(F.lit(1.0), F.col("_score") * F.when(F.col("strong_factors") >= 3, 1.2).otherwise(1.0)), 9
            ),
        )
        .drop("_score")
    )


def classifier_agreement(df: DataFrame) -> DataFrame:
    """Adds ``agreement``: 0 unless both classifiers gave a label."""
    mean = (F.coalesce("llm_confidence", F.lit(0.8)) + F.coalesce("rule_confidence", F.lit(0.8))) / 2
    both = F.col("llm_label").isNotNull() & F.col("rule_label").isNotNull()
    same = F.col("llm_label") == F.col("rule_label")
    score = F.when(~both, 0.0).when(same, F.least(F.lit(1.0), mean + 0.2)).otherwise(F.greatest(F.lit(0.1), mean * 0.5))
    return df.withColumn("agreement", score)


def confidence_level(df: DataFrame, score: str = "confidence_score") -> DataFrame:
    s = F.col(score)
    level = (
        F.when(s >= 0.95, "critical")
        .when(s >= 0.8, "very_high")
        .when(s >= 0.6, "high")
        .when(s >= 0.4, "medium")
        .when(s >= 0.2, "low")
        .otherwise("very_low")
    )
    return df.withColumn("confidence_level", level)


def weighted_vote(df: DataFrame) -> DataFrame:
    """Adds the three vote sums and ``final_label``; ties go benign, defacement, unclear."""

    def risk_vote(risk: str, weight: float, sure: float, unsure: float) -> dict[str, Column]:
        r = F.col(risk)
        high = r.isin("high", "critical")
        return {
            "defacement": F.when(high, weight * sure),
            "benign": F.when(r == "low", weight * sure),
            "unclear": F.when(r.isNotNull() & ~high & (r != "low"), weight * unsure),
        }

    semantic = risk_vote("semantic_risk", VOTE_WEIGHTS["semantic"], 0.9, 0.7)
    behavior = risk_vote("behavior_risk", VOTE_WEIGHTS["behavioral"], 0.8, 0.6)
    rules = F.col("rule_confidence") * VOTE_WEIGHTS["rule_based"] * F.when(F.col("rule_confidence") > 0.8, 1.5).otherwise(1.0)

    def votes(label: str) -> Column:
        parts = [
            F.when(F.col("llm_label") == label, F.col("llm_confidence") * VOTE_WEIGHTS["llm"]),
            F.when(F.col("rule_label") == label, rules),
            semantic[label],
            behavior[label],
        ]
        return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])

    # Sums are rounded so that a tie does not hang on the order of additions.
    voted = df.withColumns({f"{v}_votes": F.round(votes(v), 9) for v in ("benign", "defacement", "unclear")})
    benign, defaced, unclear = (F.col(f"{v}_votes") for v in ("benign", "defacement", "unclear"))
    label = (
        F.when((benign >= defaced) & (benign >= unclear), "benign")
        .when(defaced >= unclear, "defacement")
        .otherwise("unclear")
    )
    return voted.withColumn("final_label", label)


def severity_score(df: DataFrame) -> DataFrame:
    """Adds ``severity_score``; ``high_indicators`` counts indicators above 0.8."""
    base = lookup(F.col("threat_category"), BASE_SEVERITY, 0.5)
    boosted = F.when(F.col("high_indicators") > 3, F.least(F.lit(1.0), base * 1.2)).otherwise(base)
    return df.withColumn("severity_score", F.least(F.lit(1.0), boosted * F.col("confidence_score")))


def response_actions(df: DataFrame) -> DataFrame:
    """Adds ``recommended_actions`` without repeats, in order."""
    sure = F.when(F.col("confidence_level").isin(*SURE_LEVELS), _value(SURE_ACTIONS)).otherwise(_value(()))
    actions = F.concat(
        lookup(F.col("final_label"), RESPONSE_ACTIONS, ()), sure, lookup(F.col("threat_category"), CATEGORY_ACTIONS, ())
    )
    return df.withColumn("recommended_actions", F.array_distinct(actions))


def verdict_reasoning(df: DataFrame) -> DataFrame:
    """Adds ``reasoning``: one ``|``-joined line per verdict.

    ``indicators`` is an array of structs with ``category`` and ``matched_text``.
    """

    def weight(name: str) -> str:
        return f"(weight: {VOTE_WEIGHTS[name]:.2f}): "

    top = F.transform(
        F.slice("indicators", 1, 3),
        lambda i: F.concat(i["category"], F.lit(": "), F.substring(i["matched_text"], 1, 30), F.lit("...")),
    )
    has_rules = F.col("rule_label").isNotNull()
    parts = [
        F.concat(
            F.lit("Classification: "), "final_label", F.lit(" (confidence: "), fixed(F.col("confidence_score")), F.lit(")")
        ),
        F.when(has_rules, F.concat(F.lit("Primary threat type: "), "threat_category")),
        F.concat(
            F.lit("AI analysis " + weight("llm")), "llm_label", F.lit(" ("), fixed(F.col("llm_confidence")), F.lit(")")
        ),
        F.concat(
            F.lit("Rule-based detection " + weight("rule_based")), "rule_label", F.lit(" ("),
            fixed(F.col("rule_confidence")), F.lit(")"),
        ),
        F.when(has_rules & (F.size("indicators") > 0), F.concat(F.lit("Key indicators: "), F.array_join(top, ", "))),
        F.concat(F.lit("Semantic analysis " + weight("semantic") + "risk level "), "semantic_risk"),
        F.when(
            F.size("anomalies") > 0,
            F.concat(F.lit("Behavioral anomalies detected: "), F.array_join("anomalies", ", ")),
        ),
    ]
    return df.withColumn("reasoning", F.concat_ws(" | ", *parts))


def combine(df: DataFrame) -> DataFrame:
    """The whole combination: factors, confidence, level, vote, severity, actions, reasoning."""
    scored = classifier_agreement(confidence_level(confidence_score(confidence_factors(df))))
    return verdict_reasoning(response_actions(severity_score(weighted_vote(scored))))
