"""From verdicts to alerts: gate, severity, text, suppression, lifecycle, reports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.functions.text import fixed
from driftwatch.operators.ensemble import lookup
from driftwatch.operators.metrics import at, before, page_of, seconds_between
from driftwatch.operators.sliced import last_over, newest, running_sum, time_slice
from driftwatch.sources.tables import one_per_key, with_defaults

SEVERITIES = ("critical", "high", "medium", "low")

# Base severity per verdict and confidence level (low otherwise).
# The top level ``critical`` counts as ``very_high``.
SEVERITY_MATRIX = {
    "defacement/critical": "critical",
    "defacement/very_high": "critical",
    "defacement/high": "high",
    "defacement/medium": "medium",
    "defacement/low": "low",
    "defacement/very_low": "low",
    "unclear/critical": "medium",
    "unclear/very_high": "medium",
    "unclear/high": "medium",
    "unclear/medium": "low",
    "unclear/low": "low",
    "unclear/very_low": "low",
}
SEVERITY_POINTS = {"low": 1.0, "medium": 2.0, "high": 3.0, "critical": 4.0}

# Points added per escalation factor.
ESCALATION_POINTS = {
    "multiple_changes": 0.5,
    "visual_changes": 0.3,
    "suspicious_patterns": 0.4,
    "script_injection": 0.8,
    "content_replacement": 0.6,
    "historical_anomaly": 0.3,
}
SCRIPT_MARKS = ("<script", "javascript:", "eval(", "iframe")

# Minutes an alert is held back after an emitted one, by its severity.
SUPPRESSION_MINUTES = {"critical": 5, "high": 15, "medium": 30, "low": 120}

ESCALATION_LEVELS = {"low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITY_CHANNELS = {
    "critical": "#defacement-alerts",
    "high": "#defacement-alerts",
    "medium": "#security-monitoring",
    "low": "#security-monitoring",
}
SEVERITY_COLORS = {"critical": "danger", "high": "warning", "medium": "good", "low": "#2eb886"}

# Recommended actions per alert type.
TYPE_ACTIONS = {
    "suspicious_activity": (
        "Review website content manually",
        "Check for unauthorized script injections",
        "Verify content changes are legitimate",
        "Monitor closely for additional changes",
    ),
    "content_anomaly": (
        "Manual content review recommended",
        "Verify changes are authorized",
        "Check content management system logs",
    ),
    "classification_uncertainty": (
        "Manual classification needed",
        "Review AI analysis results",
        "Provide feedback to improve classification",
    ),
}
URGENT_DEFACEMENT_ACTIONS = (
    "Immediately verify website content",
    "Check server logs for unauthorized access",
    "Contact web administrator",
    "Consider taking website offline if confirmed",
)
MINOR_DEFACEMENT_ACTIONS = (
    "Verify website content",
    "Review recent content changes",
    "Monitor for additional changes",
)
URGENT_ACTION = "URGENT: Immediate action required"
TITLES = {
    "defacement_detected": "🚨 Website Defacement Detected: ",
    "suspicious_activity": "⚠️ Suspicious Activity: ",
    "content_anomaly": "📊 Content Anomaly Detected: ",
    "classification_uncertainty": "❓ Classification Uncertainty: ",
}

_HIGH_LEVELS = ("high", "very_high", "critical")


def alert_candidates(verdicts: DataFrame) -> DataFrame:
    """Verdicts that deserve an alert."""
    unclear = (F.col("final_label") == "unclear") & F.col("confidence_level").isin(*_HIGH_LEVELS)
    visual = F.coalesce("visual_significant", F.lit(False))
    return verdicts.filter(
        (F.col("final_label") == "defacement") | unclear | visual | F.coalesce(F.col("rule_confidence") > 0.7, F.lit(False))
    )


def script_injection_flag(items: Column) -> Column:
    """True if any change item mentions a script mark."""

    def marked(item: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(F.lower(item), F.lit(m)) for m in SCRIPT_MARKS])

    return F.coalesce(F.exists(items, marked), F.lit(False))


def historical_anomaly(patterns: DataFrame) -> DataFrame:
    """Sites that change more than every second scan, on average within the hour."""
    return patterns.filter((F.col("change_frequency") > 0.5) & (F.col("avg_change_interval_seconds") < 3600))


def alert_severity(df: DataFrame) -> DataFrame:
    """Adds base severity, escalation factors, points and the final ``severity``."""
    base = lookup(F.concat_ws("/", "final_label", "confidence_level"), SEVERITY_MATRIX, "low")
    named = F.exists("triggered_rules", lambda r: F.contains(r, F.lit("defacement")) | F.contains(r, F.lit("hacked")))
    factors = {
        "multiple_changes": F.size(F.split("change_type", ",")) > 2,
        "visual_changes": F.col("visual_significant"),
        "suspicious_patterns": named,
        "script_injection": script_injection_flag(F.col("change_items")),
        "content_replacement": F.col("content_similarity") < 0.3,
        "historical_anomaly": (F.col("change_frequency") > 0.5) & (F.col("avg_change_interval_seconds") < 3600),
    }
    factors = {n: F.coalesce(c, F.lit(False)) for n, c in factors.items()}
    added = reduce(lambda a, b: a + b, [F.when(c, ESCALATION_POINTS[n]).otherwise(0.0) for n, c in factors.items()])
    staged = df.withColumn("base_severity", base)
    points = F.round(lookup(F.col("base_severity"), SEVERITY_POINTS, 1.0) + added, 9)
    staged = staged.withColumns(
        {
            "severity_points": points,
            "escalation_factors": F.array_compact(F.array(*[F.when(c, n) for n, c in factors.items()])),
        }
    )
    p = F.col("severity_points")
    return staged.withColumn(
        "severity", F.when(p >= 3.5, "critical").when(p >= 2.5, "high").when(p >= 1.5, "medium").otherwise("low")
    )


def alert_type(df: DataFrame) -> DataFrame:
    """Adds ``alert_type`` from verdict, severity and confidence level."""
    return df.withColumn(
        "alert_type",
        F.when(
            F.col("final_label") == "defacement",
            F.when(F.col("severity").isin("critical", "high"), "defacement_detected").otherwise("suspicious_activity"),
        )
        .when(
            F.col("final_label") == "unclear",
            F.when(F.col("confidence_level").isin(*_HIGH_LEVELS), "content_anomaly").otherwise("classification_uncertainty"),
        )
        .otherwise("suspicious_activity"),
    )


def alert_text(df: DataFrame) -> DataFrame:
    """Adds ``title`` and ``description`` per alert type."""
    kind = F.col("alert_type")
    site = F.concat(F.lit("Website: "), "website_url")
    score = fixed(F.col("confidence_score"))
    rules = F.when(F.size("triggered_rules") > 0, F.array_join(F.slice("triggered_rules", 1, 3), ", "))

    def lines(*parts: Column) -> Column:
        return F.concat_ws("\n", *parts)

    defaced = lines(
        site,
        F.concat(F.lit("Classification: "), F.initcap("final_label")),
        F.concat(F.lit("Confidence: "), score, F.lit(" ("), "confidence_level", F.lit(")")),
        F.concat(F.lit("AI Analysis: "), F.substring("llm_explanation", 1, 200), F.lit("...")),
        F.concat(F.lit("Triggered Rules: "), rules),
        F.concat(F.lit("Content Similarity: "), fixed(F.col("content_similarity"))),
    )
    suspicious = lines(
        site,
        F.concat(F.lit("Suspicious patterns detected with "), score, F.lit(" confidence")),
        F.concat(F.lit("Patterns: "), rules),
        F.when(F.col("visual_significant"), "Visual changes detected"),
    )
    anomaly = lines(
        site,
        F.lit("Significant content changes detected"),
        F.concat(F.lit("Analysis confidence: "), score),
        F.concat(F.lit("Change types: "), F.array_join(F.split("change_type", ","), ", ")),
    )
    unsure = lines(
        site,
        F.concat(F.lit("Classification uncertain despite "), "confidence_level", F.lit(" confidence")),
        F.lit("Manual review recommended"),
        F.concat(F.lit("AI reasoning: "), F.substring("llm_reasoning", 1, 150), F.lit("...")),
    )
    body = (
        F.when(kind == "defacement_detected", defaced)
        .when(kind == "suspicious_activity", suspicious)
        .when(kind == "content_anomaly", anomaly)
        .when(kind == "classification_uncertainty", unsure)
        .otherwise(F.concat(F.lit("An alert has been generated for "), "website_url"))
    )
    return df.withColumns(
        {"title": F.concat(lookup(kind, TITLES, "🔍 Alert: "), F.col("website_name")), "description": body}
    )


def alert_actions(df: DataFrame) -> DataFrame:
    """Adds ``alert_actions``; critical alerts start with the urgent notice."""
    serious = F.col("severity").isin("critical", "high")
    defaced = F.when(serious, F.array(*map(F.lit, URGENT_DEFACEMENT_ACTIONS))).otherwise(
        F.array(*map(F.lit, MINOR_DEFACEMENT_ACTIONS))
    )
    actions = F.when(F.col("alert_type") == "defacement_detected", defaced).otherwise(
        lookup(F.col("alert_type"), TYPE_ACTIONS, ())
    )
    urgent = F.when(F.col("severity") == "critical", F.array(F.lit(URGENT_ACTION))).otherwise(
        F.array().cast("array<string>")
    )
    return df.withColumn("alert_actions", F.concat(urgent, actions))


def escalation_level(severity: Column) -> Column:
    return lookup(severity, ESCALATION_LEVELS, 1)


def severity_channel(severity: Column) -> Column:
    return lookup(severity, SEVERITY_CHANNELS, "#security-monitoring")


def alert_payload(df: DataFrame) -> DataFrame:
    """Adds ``payload``: the message of an alert as a JSON text."""

    def field(title: str, value: Column, short: bool = True) -> Column:
        return F.struct(F.lit(title).alias("title"), value.alias("value"), F.lit(short).alias("short"))

    actions = F.concat(
        F.lit("Recommended Actions:\n"),
        F.array_join(F.transform(F.slice("alert_actions", 1, 5), lambda a: F.concat(F.lit("• "), a)), "\n"),
    )
    score = F.when(F.col("confidence_score") != 0, fixed(F.col("confidence_score")))
    fields = F.array_compact(
        F.array(
            field("Website", F.col("website_url")),
            field("Severity", F.initcap("severity")),
            field("Classification", F.coalesce("final_label", F.lit("Unknown"))),
            field("Confidence", F.coalesce(score, F.lit("Unknown"))),
            F.when(F.size("alert_actions") > 0, field("Recommended Actions", actions, False)),
        )
    )
    attachment = F.struct(
        lookup(F.col("severity"), SEVERITY_COLORS, "good").alias("color"),
        fields.alias("fields"),
        F.col("description").alias("text"),
    )
    message = F.struct(F.col("title").alias("text"), F.array(attachment).alias("attachments"))
    return df.withColumn("payload", F.to_json(message))


def raise_alerts(verdicts: DataFrame) -> DataFrame:
    """Candidates with severity, type, text, actions, channel and suppression key."""
    typed = alert_type(alert_severity(alert_candidates(verdicts)))
    written = alert_actions(alert_text(typed))
    return written.withColumns(
        {
            "escalation_level": escalation_level(F.col("severity")),
            "channel": severity_channel(F.col("severity")),
            "suppression_key": F.concat_ws(":", "website_id", "alert_type"),
        }
    )


# --- suppression -----------------------------------------------------------


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Runs of rows with equal keys from key-sorted batches, across batch ends."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if rest and all(batch[k].iloc[0] == rest[0][k].iloc[0] == batch[k].iloc[-1] for k in keys):
            rest.append(batch)  # the run goes on: its parts are joined once, at its end
            continue
        pdf = pd.concat([*rest, batch], ignore_index=True) if rest else batch
        changed = np.zeros(len(pdf) - 1, dtype=bool)
        for k in keys:
            values = pdf[k].to_numpy()
            changed |= values[1:] != values[:-1]
        starts = np.r_[0, np.flatnonzero(changed) + 1]
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        for lo, hi in zip(starts[:-1], starts[1:]):
            yield tuple(columns[k][lo] for k in keys), {c: v[lo:hi] for c, v in columns.items()}
        rest = [pdf.iloc[starts[-1] :]]
    if rest:
        pdf = pd.concat(rest, ignore_index=True)
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        yield tuple(columns[k][0] for k in keys), columns


def _release_bounds(times: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Running maximum of ``time - window``.

    After a last emission at ``t`` the first alert to pass is the first one
    whose bound is at least ``t``.
    """
    return np.maximum.accumulate(times - windows)


def _summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per slice: the last emission after it as a step function of the one before it."""
    out: dict[str, list] = {"key": [], "slice": [], "until": [], "outcome": []}
    for (key, part), rows in _runs(batches, ["key", "slice"]):
        times = rows["at"]
        bound = _release_bounds(times, rows["window"])
        follow = np.searchsorted(bound, times, side="left")
        final = np.arange(len(times))
        for i in range(len(times) - 2, -1, -1):
            if follow[i] < len(times):
                final[i] = final[follow[i]]
        entries = np.flatnonzero(np.r_[True, bound[1:] > bound[:-1]])
        outcome = times[final[entries]]
        ends = np.flatnonzero(np.r_[outcome[1:] != outcome[:-1], True])
        out["key"].append(key)
        out["slice"].append(part)
        out["until"].append(bound[entries[ends]].tolist())
        out["outcome"].append(outcome[ends].tolist())
    if out["key"]:
        yield pd.DataFrame(out, dtype=object).astype({"slice": "int64"})


def _chain_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last emission before every slice, from the step functions of a key in order."""
    out: dict[str, list] = {"key": [], "slice": [], "at": []}
    for (key,), rows in _runs(batches, ["key"]):
        state = None
        for part, until, outcome in zip(rows["slice"], rows["until"], rows["outcome"]):
            if state is not None:
                out["key"].append(key)
                out["slice"].append(part)
                out["at"].append(state)
            step = 0 if state is None else int(np.searchsorted(until, state, side="left"))
            if step < len(outcome):
                state = int(outcome[step])
    if out["key"]:
        yield pd.DataFrame(out, dtype=object).astype({"slice": "int64", "at": "int64"})


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids emitted per slice; a row without id carries the last emission before it."""
    kept: list = []
    for _, rows in _runs(batches, ["key", "slice"]):
        carried = rows["is_state"]
        real = ~carried
        times, ids = rows["at"][real], rows["id"][real]
        bound = _release_bounds(times, rows["window"][real])
        i = int(np.searchsorted(bound, rows["at"][carried][0], side="left")) if carried.any() else 0
        while i < len(times):
            kept.append(ids[i])
            i = int(np.searchsorted(bound, times[i], side="left"))
    yield pd.DataFrame({"id": kept})


def suppression_micros(severity: Column) -> Column:
    return lookup(severity, {k: v * 60_000_000 for k, v in SUPPRESSION_MINUTES.items()}, 30 * 60_000_000).cast("long")


def suppress_alerts(alerts: DataFrame, slice_seconds: int = 21_600) -> DataFrame:
    """Alerts that pass suppression per ``website_id:alert_type``.

    An alert passes if no alert of its key was emitted within the window of its
    own severity; only emitted alerts restart the window, so the result depends
    on order. Each key is cut into time slices: a slice is first reduced to the
    step function it applies to the last emission time, the slices of a key are
    chained over these small summaries, and then every slice is replayed with
    its true starting state. No task needs more than one slice of a key at once.
    """
    id_type = alerts.schema["id"].dataType
    narrow = alerts.select(
        F.concat_ws(":", "website_id", "alert_type").alias("key"),
        time_slice("created_at", slice_seconds).alias("slice"),
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"),
        "id",
        suppression_micros(F.col("severity")).alias("window"),
        F.lit(False).alias("is_state"),
    )
    slices = narrow.repartition("key", "slice").sortWithinPartitions("key", "slice", "at", "id")
    summaries = slices.mapInPandas(_summarize, "key string, slice long, until array<long>, outcome array<long>")
    states = (
        summaries.repartition("key")
        .sortWithinPartitions("key", "slice")
        .mapInPandas(_chain_slices, "key string, slice long, at long")
        .select("key", "slice", "at", F.lit(None).cast(id_type).alias("id"), F.lit(0).cast("long").alias("window"), F.lit(True).alias("is_state"))
    )
    # The state row of a slice is older than its alerts and sorts first.
    kept = (
        narrow.unionByName(states)
        .repartition("key", "slice")
        .sortWithinPartitions("key", "slice", "at", "id")
        .mapInPandas(_replay, T.StructType([T.StructField("id", id_type)]))
    )
    return alerts.join(kept, "id", "left_semi")


# --- lifecycle -------------------------------------------------------------


def acknowledge(alerts: DataFrame, requests: DataFrame) -> DataFrame:
    """Open alerts named in ``requests(id, acknowledged_by, acknowledged_at)`` become acknowledged.

    The earliest of several requests for an alert counts; earlier acknowledgements stay as they are.
    """
    side = requests.select("id", F.col("acknowledged_at").alias("_at"), F.col("acknowledged_by").alias("_by"))
    side = one_per_key(side.filter(F.col("_at").isNotNull()), "id", [F.col("_at")])
    alerts = with_defaults(alerts, {"acknowledged_by": F.lit(None).cast("string"), "acknowledged_at": F.lit(None).cast("timestamp_ntz")})
    joined = alerts.join(side, "id", "left")
    hit = (F.col("status") == "open") & F.col("_at").isNotNull()
    return joined.withColumns(
        {
            "acknowledged_by": F.when(hit, F.col("_by")).otherwise(F.col("acknowledged_by")),
            "acknowledged_at": F.when(hit, F.col("_at")).otherwise(F.col("acknowledged_at")),
            "status": F.when(hit, "acknowledged").otherwise(F.col("status")),
        }
    ).drop("_by", "_at")


def resolve(alerts: DataFrame, requests: DataFrame) -> DataFrame:
    """Alerts named in ``requests(id, resolved_at)`` become resolved unless they are; the earliest request counts."""
    side = requests.filter(F.col("resolved_at").isNotNull()).groupBy("id").agg(F.min("resolved_at").alias("_at"))
    joined = alerts.join(side, "id", "left")
    hit = (F.col("status") != "resolved") & F.col("_at").isNotNull()
    return joined.withColumns(
        {
            "resolved_at": F.when(hit, F.col("_at")).otherwise(F.col("resolved_at")),
            "status": F.when(hit, "resolved").otherwise(F.col("status")),
        }
    ).drop("_at")


def patch(alerts: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply ``patches(id, new_status, by, at)``; the new status sets its own stamps, others stay.

    The latest of several patches of an alert counts.
    """
    side = patches.select("id", "at", "new_status", "by")
    latest = side.groupBy("id").agg(F.max(F.struct("at", "new_status", "by")).alias("_last")).select("id", "_last.*")
    alerts = with_defaults(alerts, {"acknowledged_by": F.lit(None).cast("string"), "acknowledged_at": F.lit(None).cast("timestamp_ntz")})
    joined = alerts.join(latest, "id", "left")
    to = F.col("new_status")
    return joined.withColumns(
        {
            "acknowledged_by": F.when(to == "acknowledged", F.col("by")).otherwise(F.col("acknowledged_by")),
            "acknowledged_at": F.when(to == "acknowledged", F.col("at")).otherwise(F.col("acknowledged_at")),
            "resolved_at": F.when(to == "resolved", F.col("at")).otherwise(F.col("resolved_at")),
            "status": F.coalesce(to, F.col("status")),
        }
    ).drop("new_status", "by", "at")


def bulk_acknowledge(alerts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts after ``requests(id, acknowledged_by, acknowledged_at)``, and the outcome of each requested id.

    The outcome is ``updated`` for every known alert, also one that was not open, and ``not_found`` otherwise.
    """
    known = alerts.select("id").withColumn("_known", F.lit(True))
    outcome = requests.select("id").distinct().join(known, "id", "left").select(
        "id", F.when(F.col("_known"), "updated").otherwise("not_found").alias("outcome")
    )
    return acknowledge(alerts, requests), outcome


# --- lists and reports -----------------------------------------------------


def list_alerts(
    alerts: DataFrame, sites: DataFrame, page: int = 1, page_size: int = 20, status: str | None = None,
    severity: str | None = None, alert_type: str | None = None, website_id: int | None = None,
) -> DataFrame:
    """One page of alerts, newest first, with the site name (or ``Unknown``)."""
    chosen = alerts
    for column, value in (("status", status), ("severity", severity), ("alert_type", alert_type), ("website_id", website_id)):
        if value is not None:
            chosen = chosen.filter(F.col(column) == value)
    rows = page_of(chosen, [F.col("created_at").desc(), F.col("id").desc()], page, page_size)
    names = sites.select(F.col("id").alias("website_id"), F.col("name").alias("website_name"))
    return rows.join(names, "website_id", "left").withColumn("website_name", F.coalesce("website_name", F.lit("Unknown")))


def open_alerts(alerts: DataFrame, limit: int = 50, website_id: int | None = None) -> DataFrame:
    """The newest open alerts."""
    chosen = alerts.filter(F.col("status") == "open")
    if website_id is not None:
        chosen = chosen.filter(F.col("website_id") == website_id)
    return chosen.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def alert_stats(alerts: DataFrame, as_of: str) -> DataFrame:
    """Counts by status, severity and period, and mean resolution hours, in one pass."""
    hours = seconds_between("created_at", "resolved_at") / 3600
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_alerts") for s in ("open", "acknowledged", "resolved")],
        *[F.count_if(F.col("severity") == s).alias(f"{s}_alerts") for s in SEVERITIES],
        F.count_if(F.to_date("created_at") == F.to_date(at(as_of))).alias("alerts_today"),
        F.count_if(F.col("created_at") >= before(as_of, 168)).alias("alerts_this_week"),
        F.avg(F.when(F.col("status") == "resolved", hours)).alias("avg_resolution_time_hours"),
    )


def alert_summary(alerts: DataFrame, latest: int = 5) -> DataFrame:
    """Counts per severity present, in fixed order, then the newest alerts."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(SEVERITIES, 1) for x in (s, i)])
    counts = (
        alerts.groupBy("severity")
        .agg(F.count(F.lit(1)).alias("n_alerts"))
        .select(
            F.lit("severity").alias("section"), order[F.col("severity")].alias("position"), F.col("severity").alias("label"),
            "n_alerts", F.lit(None).cast("long").alias("alert_id"),
        )
    )
    top = alerts.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(latest)
    ranked = top.agg(
        F.sort_array(F.collect_list(F.struct("created_at", "id", "severity")), asc=False).alias("_rows")
    ).select(F.posexplode("_rows").alias("_pos", "_row"))
    recent = ranked.select(
        F.lit("recent").alias("section"), (F.col("_pos") + 1).alias("position"),
        F.concat(F.date_format("_row.created_at", "HH:mm"), F.lit(" "), F.col("_row.severity")).alias("label"),
        F.lit(1).cast("long").alias("n_alerts"), F.col("_row.id").alias("alert_id"),
    )
    return counts.unionByName(recent)


def alert_rate(alerts: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Alerts per hour since a time; periods under an hour count as one hour."""
    since = before(as_of, hours)
    elapsed = F.greatest(seconds_between(since, at(as_of)) / 3600, F.lit(1.0))
    return alerts.filter((F.col("created_at") >= since) & (F.col("created_at") <= at(as_of))).agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("status") == "open").alias("open_alerts"),
        F.count_if(F.col("status") == "resolved").alias("resolved_alerts"),
        (F.count(F.lit(1)) / elapsed).alias("alert_rate"),
    )


def undelivered_alerts(alerts: DataFrame, depth: int = 5) -> DataFrame:
    """Open, never notified alerts among the newest ``depth`` of each site."""
    recent = newest(alerts, ["website_id"], [F.col("created_at").desc(), F.col("id").desc()], depth)
    return recent.filter((F.col("status") == "open") & (F.col("notifications_sent") == 0))


def site_down_alerts(snaps: DataFrame, slice_seconds: int = 86_400) -> DataFrame:
    """Failed scans with the number of failures before them in the same outage."""
    keys, order, cut = ["website_id"], ["captured_at", "id"], time_slice("captured_at", slice_seconds)
    failed = F.col("status_code") != 200
    counted = running_sum(snaps, keys, order, cut, {"_failures": failed.cast("long")})
    good = F.when(~failed, F.struct("captured_at", "_failures"))
    seen = last_over(counted, keys, order, cut, {"_ok": good})
    return seen.filter(failed).select(
        "id", "website_id", "captured_at", "status_code",
        (F.col("_failures") - F.coalesce("_ok._failures", F.lit(0)) - 1).alias("retry_count"),
        F.col("_ok.captured_at").alias("last_successful"),
    )
