from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from driftwatch.operators import routing

ALERTS = "id long, website_id long, alert_type string, severity string, region string"


def matches(template, alert):
    if template[1] != alert["router_type"]:
        return False
    for field, values in template[5].items():
        have = alert.get(field)
        if have is not None and str(have) not in values:
            return False
    return True


def test_ten_thousand_templates_equal_a_walk_over_all(spark):
    rng = random.Random(4)
    kinds = ["defacement", "site_down", "system_error"]
    templates = []
    for k in range(10_000):
        conditions = {}
        if k % 4:
            conditions["website_id"] = [str(rng.randrange(300)) for _ in range(rng.randint(1, 3))]
        if k % 3:
            conditions["severity"] = rng.sample(["critical", "high", "low"], rng.randint(0, 2))
        if k % 4 == 0:
            conditions["region"] = [f"r{rng.randrange(200)}"]
        if k % 5 == 0:
            conditions["absent"] = ["x"]
        templates.append((f"t{k:05d}", rng.choice(kinds), rng.choice(["critical", "high", "medium", "low", "odd"]), [f"#{k % 50}"], [], conditions, 0, 0, k % 7))
    templates.append(("standard_defacement", "nothing", "low", ["#spare"], [], {}, 0, 0, 0))
    alerts = []
    for k in range(200):
        kind = rng.choice(["defacement_detected", "site_down", "system_error", "benign_change", "strange", None])
        alerts.append((k, rng.choice([None, *range(0, 300, 7)]), kind, rng.choice(["critical", "high", "low", None, "other"]), rng.choice([None, "r1", "r2"])))
    table = spark.createDataFrame(templates, routing.TEMPLATE_DDL)
    frame = spark.createDataFrame(alerts, ALERTS)
    out = routing.route_alerts(frame, table)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan
    got = {r.id: (r.router_type, r.template_ids, r.channels) for r in out.collect()}
    assert len(got) == len(alerts)
    rank = {"critical": 0, "high": 1, "medium": 2, "low": 3}
    types = {"defacement_detected": "defacement"}
    n_fallback = 0
    for k, site, kind, severity, region in alerts:
        router_type = types.get(kind, kind) if kind not in ("strange", None) else None
        alert = {"router_type": router_type, "website_id": site, "severity": severity, "region": region}
        hit = sorted((t for t in templates if router_type and matches(t, alert)), key=lambda t: (rank.get(t[2], 9), t[8], t[0]))
        spare = [] if router_type == "site_down" else [templates[-1]]
        n_fallback += not hit
        want = hit or spare
        assert got[k] == (router_type, [t[0] for t in want], sorted({c for t in want for c in t[3]})), (k, kind)
    assert n_fallback


def test_records_and_their_table_route_alike(spark):
    rows = [(k, k % 5, kind, severity, None) for k, (kind, severity) in enumerate((a, b) for a in ("defacement", "site_down", "benign_change", "odd", None) for b in ("critical", "low", None))]
    frame = spark.createDataFrame(rows, ALERTS).withColumns({"status": F.lit("open"), "created_at": F.lit("2024-01-29 23:00:00").cast("timestamp_ntz")})
    table = routing.template_table(spark, routing.DEFAULT_TEMPLATES)
    as_rows = lambda df: sorted(map(str, df.collect()))
    for run in (
        lambda t: routing.route_alerts(frame, t).select("id", "router_type", "template_ids", "channels", "users"), lambda t: routing.throttle_notifications(frame, t),
        lambda t: routing.escalations_due(frame, "2024-01-30 00:00:00", t), lambda t: routing.template_stats(frame, "2024-01-30 00:00:00", t),
    ):
        assert as_rows(run(table)) == as_rows(run(routing.DEFAULT_TEMPLATES))
    assert routing.route_alerts(frame, table.limit(0)).filter(F.size("template_ids") > 0).isEmpty()
    assert routing.route_alerts(frame, [*routing.DEFAULT_TEMPLATES] * 100).count() == len(rows)


def test_templates_that_share_a_common_value_do_not_meet_every_alert(spark):
    """Three templates a site, so a severity alone names 12,000 of them: met by that, 36,000 combinations would give 432 million rows."""
    n, levels = 12_000, ["critical", "high", "low"]
    sites = spark.range(n).withColumn("severity", F.explode(F.array(*map(F.lit, levels))))
    name = F.concat_ws("_", F.col("id").cast("string"), "severity")
    conditions = F.create_map(F.lit("website_id"), F.array(F.col("id").cast("string")), F.lit("severity"), F.array("severity"))
    none = F.array().cast("array<string>")
    table = sites.select(
        name.alias("template_id"), F.lit("defacement").alias("alert_type"), F.lit("high").alias("priority"), F.array(name).alias("channels"),
        none.alias("users"), conditions.alias("conditions"), F.lit(0).alias("throttle_minutes"), F.lit(0).alias("escalation_minutes"),
    )
    alerts = sites.select(name.alias("id"), F.col("id").alias("website_id"), F.lit("defacement").alias("alert_type"), "severity")
    start = time.time()
    out = routing.route_alerts(alerts, table)
    assert out.filter(F.col("template_ids") == F.array("id")).count() == n * len(levels)
    assert time.time() - start < 60
