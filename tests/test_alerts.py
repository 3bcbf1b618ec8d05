from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftwatch.operators import alerts as al
from driftwatch.operators import routing
from driftwatch.plans.alert_queries import context
from driftwatch.plans.views import Fixtures

START = dt.datetime(2024, 1, 1)
COLUMNS = "id long, website_id long, alert_type string, severity string, created_at timestamp_ntz"


def greedy(rows):
    last, kept = {}, set()
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        key = (r[1], r[2])
        window = dt.timedelta(minutes=al.SUPPRESSION_MINUTES[r[3]])
        if key not in last or r[4] - last[key] >= window:
            last[key] = r[4]
            kept.add(r[0])
    return kept


def dense(seed: int, n: int = 700):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        site = 1 if rng.random() < 0.6 else rng.randrange(2, 6)
        at = START + dt.timedelta(seconds=rng.randrange(0, 2 * 86_400, rng.choice([1, 60, 300])))
        rows.append((i, site, rng.choice(["a", "b"]), rng.choice(al.SEVERITIES), at))
    return rows


@pytest.mark.parametrize("seed, slice_seconds", [(1, 600), (2, 3600), (3, 21_600), (4, 10**7)])
def test_suppression_equals_the_greedy_walk(spark, seed, slice_seconds):
    rows = dense(seed)
    out = al.suppress_alerts(spark.createDataFrame(rows, COLUMNS), slice_seconds)
    assert {r.id for r in out.collect()} == greedy(rows)


def test_suppression_golden(spark):
    rows = [
        (1, 1, "a", "high", START),
        (2, 1, "a", "high", START + dt.timedelta(minutes=1)),
        (3, 1, "a", "critical", START + dt.timedelta(minutes=6)),
        (4, 1, "a", "high", START + dt.timedelta(minutes=16)),
        (5, 1, "a", "low", START + dt.timedelta(minutes=125)),
        (6, 2, "a", "high", START + dt.timedelta(minutes=1)),
    ]
    out = al.suppress_alerts(spark.createDataFrame(rows, COLUMNS))
    # 4 is ten minutes after 3, which was emitted: still inside its 15 minutes
    assert sorted(r.id for r in out.collect()) == [1, 3, 6]


def verdict(spark, label, level, score=0.9, **extra):
    row = {
        "final_label": label, "confidence_level": level, "confidence_score": score, "rule_confidence": 0.1,
        "visual_significant": False, "triggered_rules": ["xss: a..."], "change_type": "content", "change_items": ["x"],
        "content_similarity": 0.9, "change_frequency": 0.0, "avg_change_interval_seconds": 0.0, "website_id": 1,
        "website_name": "Test Site", "website_url": "https://t.example/", "llm_explanation": "e", "llm_reasoning": "r", **extra,
    }
    schema = (
        "final_label string, confidence_level string, confidence_score double, rule_confidence double, visual_significant boolean, "
        "triggered_rules array<string>, change_type string, change_items array<string>, content_similarity double, "
        "change_frequency double, avg_change_interval_seconds double, website_id long, website_name string, website_url string, "
        "llm_explanation string, llm_reasoning string"
    )
    return spark.createDataFrame([tuple(row.values())], schema)


def test_sure_defacement_is_critical(spark):
    row = al.raise_alerts(verdict(spark, "defacement", "very_high")).first()
    assert row.alert_type == "defacement_detected" and row.severity == "critical" and "Defacement" in row.title
    assert row.alert_actions[0].startswith("URGENT") and row.escalation_level == 4


def test_top_level_counts_as_very_high(spark):
    assert al.raise_alerts(verdict(spark, "defacement", "critical", 0.97)).first().severity == "critical"
    assert al.raise_alerts(verdict(spark, "unclear", "critical", 0.97)).first().alert_type == "content_anomaly"


def test_benign_raises_nothing(spark):
    assert al.raise_alerts(verdict(spark, "benign", "very_high")).count() == 0
    assert al.raise_alerts(verdict(spark, "benign", "low", visual_significant=True)).count() == 1


def test_votes_and_confidence_are_bounded(spark):
    t = Fixtures(spark, "/root/testdata/sf0.001")
    bad = context(t).filter(
        (F.col("confidence_score") < 0) | (F.col("confidence_score") > 1) | (F.col("severity_score") > 1)
        | (F.col("benign_votes") + F.col("defacement_votes") + F.col("unclear_votes") > 1)
    )
    assert bad.count() == 0


def test_routing_fallback_and_null_severity(spark):
    rows = [(1, 1, "defacement", None, START), (2, 1, "other", "high", START), (3, 1, "defacement", "odd", START)]
    out = {r.id: r for r in routing.route_alerts(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert out[1].template_ids == ["critical_defacement", "high_defacement", "standard_defacement"]
    assert out[2].template_ids == ["standard_defacement"] and out[3].template_ids == ["standard_defacement"]
    assert out[1].users == ["@on-call", "@security-team"]


def test_lifecycle_keeps_what_was_there_and_takes_one_request_per_id(spark):
    from datetime import datetime

    t1, t2, t3 = (datetime(2024, 1, d) for d in (1, 2, 3))
    base = spark.createDataFrame(
        [("a1", "acknowledged", "bob", t1, None), ("a2", "open", None, None, None), ("a3", "resolved", "eve", t1, t1)],
        "id string, status string, acknowledged_by string, acknowledged_at timestamp_ntz, resolved_at timestamp_ntz",
    )
    rows = lambda df: {r.id: tuple(r)[1:] for r in df.select("id", "status", "acknowledged_by", "acknowledged_at", "resolved_at").collect()}
    asked = spark.createDataFrame([("a2", "late", t3), ("a2", "early", t2), ("a1", "x", t2), ("zz", "x", t2)], "id string, acknowledged_by string, acknowledged_at timestamp_ntz")
    updated, outcome = al.bulk_acknowledge(base, asked)
    assert updated.count() == 3
    assert rows(updated) == {"a1": ("acknowledged", "bob", t1, None), "a2": ("acknowledged", "early", t2, None), "a3": ("resolved", "eve", t1, t1)}
    assert {r.id: r.outcome for r in outcome.collect()} == {"a1": "updated", "a2": "updated", "zz": "not_found"}
    done = al.resolve(base, spark.createDataFrame([("a1", t3), ("a1", t2)], "id string, resolved_at timestamp_ntz"))
    assert done.count() == 3 and rows(done)["a1"] == ("resolved", "bob", t1, t2)
    patches = spark.createDataFrame([("a1", "resolved", "ops", t2), ("a1", "open", "ops", t1), ("a2", "acknowledged", "ops", t2)], "id string, new_status string, by string, at timestamp_ntz")
    patched = al.patch(base, patches)
    assert patched.count() == 3
    assert rows(patched) == {"a1": ("resolved", "bob", t1, t2), "a2": ("acknowledged", "ops", t2, None), "a3": ("resolved", "eve", t1, t1)}


def test_suppression_of_a_hot_key_with_text_ids(spark):
    rows = spark.range(4000).selectExpr("concat('x', id) AS id", "1 AS website_id", "'defacement' AS alert_type", "'high' AS severity", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 20) AS created_at")
    got = [r.id for r in al.suppress_alerts(rows, slice_seconds=3000).orderBy("created_at").collect()]
    assert got == [f"x{k}" for k in range(0, 4000, 45)]
