"""Notification routing: templates, throttling, escalation, delivery batches.

Templates are a short list of records held by the job and matched row by row inside the plan, or a table of any size with
a map of conditions, matched through an inverted index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.operators.metrics import at, before, seconds_between
from driftwatch.operators.sliced import lag_over, running_sum, time_slice


@dataclass(frozen=True)
class Template:
    """Where alerts of a type go; ``severities`` empty means any severity."""

    template_id: str
    alert_type: str
    priority: str
    channels: tuple[str, ...]
    users: tuple[str, ...] = ()
    severities: tuple[str, ...] = ()
    throttle_minutes: int = 0
    escalation_minutes: int = 0


# The default templates.
DEFAULT_TEMPLATES = (
    Template("critical_defacement", "defacement", "critical", ("#security-alerts", "#incidents"), ("@security-team",), ("critical",), 5, 15),
    Template("high_defacement", "defacement", "high", ("#security-alerts",), ("@on-call",), ("high",), 10, 30),
    Template("standard_defacement", "defacement", "medium", ("#monitoring",), (), ("medium", "low"), 15, 0),
    Template("site_down_critical", "site_down", "high", ("#infrastructure", "#monitoring"), ("@sre-team",), (), 5, 20),
    Template("system_error", "system_error", "medium", ("#monitoring",), ("@admin",), (), 30, 0),
    Template("benign_change", "benign_change", "low", ("#monitoring",), (), (), 60, 0),
)
FALLBACKS = {"site_down": "site_down_critical"}
DEFAULT_FALLBACK = "standard_defacement"
PRIORITIES = ("critical", "high", "medium", "low")
#: Up to so many records are matched inside the plan; more become a table.
MAX_TEMPLATES = 500
TEMPLATE_DDL = (
    "template_id string, alert_type string, priority string, channels array<string>, users array<string>, "
    "conditions map<string,array<string>>, throttle_minutes int, escalation_minutes int, position int"
)
_SHOWN = ("template_id", "alert_type", "priority", "channels", "users", "throttle_minutes", "escalation_minutes")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _literal(templates) -> Column:
    """Templates in priority order as an array-of-structs literal."""
    rank = {p: i for i, p in enumerate(PRIORITIES)}
    ordered = sorted(templates, key=lambda t: rank.get(t.priority, 9))
    return F.array(
        *[
            F.struct(
                F.lit(t.template_id).alias("template_id"),
                F.lit(t.alert_type).alias("alert_type"),
                F.lit(t.priority).alias("priority"),
                _strings(t.channels).alias("channels"),
                _strings(t.users).alias("users"),
                _strings(t.severities).alias("severities"),
                F.lit(t.throttle_minutes).alias("throttle_minutes"),
                F.lit(t.escalation_minutes).alias("escalation_minutes"),
            )
            for t in ordered
        ]
    )


def template_table(spark: SparkSession, templates) -> DataFrame:
    """Template records as a table (see ``TEMPLATE_DDL``); their order decides among equal priorities."""
    rows = [
        (t.template_id, t.alert_type, t.priority, list(t.channels), list(t.users), {"severity": list(t.severities)} if t.severities else {}, t.throttle_minutes, t.escalation_minutes, k)
        for k, t in enumerate(templates)
    ]
    return spark.createDataFrame(rows, TEMPLATE_DDL)


def _as_table(alerts: DataFrame, templates) -> DataFrame | None:
    """The table form, where templates are a table or too many for the plan."""
    if isinstance(templates, DataFrame):
        return templates
    return template_table(alerts.sparkSession, templates) if len(templates) > MAX_TEMPLATES else None


def _known(value: Column) -> Column:
    """A value as a token that is never null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def matched_by_index(alerts: DataFrame, templates: DataFrame) -> DataFrame:
    """``matched_templates`` for a table of templates (``TEMPLATE_DDL``; ``position`` may be absent).

    ``conditions`` maps columns of ``alerts`` to the values they may have. A template matches if each condition holds; a
    null or absent column satisfies its condition, an empty list of values only that way. Alerts are reduced to their
    distinct combinations of the columns that conditions name; each combination meets the index of (type, column, value)
    in one equi-join. The index holds a template under the one of its conditions whose values the fewest templates share;
    the others are tested on what is met. Equal priorities go by
    ``position``, then by id; a template id that repeats counts as one (the first by position).
    """
    spare = F.col("position") if "position" in templates.columns else F.lit(0)
    rank = F.coalesce(*[F.when(F.col("priority") == p, F.lit(i)) for i, p in enumerate(PRIORITIES)], F.lit(9))
    table = templates.filter(F.col("template_id").isNotNull()).select(
        "template_id", F.struct(rank.alias("rank"), F.coalesce(spare, F.lit(0)).alias("position"), *[F.col(c) for c in _SHOWN]).alias("t"), "conditions"
    )
    table = table.groupBy("template_id").agg(F.min_by(F.struct("t", "conditions"), F.struct("t.position", "t.rank", "t.alert_type", "t.channels", "t.users")).alias("o")).select("template_id", "o.*")
    named = table.select(F.explode(F.map_keys("conditions")).alias("f")).filter(F.col("f").isin(alerts.columns)).distinct()
    fields = sorted(r["f"] for r in named.collect())  # at most the columns of the alerts
    held = F.filter(F.map_entries(F.coalesce("conditions", F.create_map().cast("map<string,array<string>>"))), lambda e: e["key"].isin(fields))
    token = lambda field, value: F.struct(field.alias("field"), value.alias("value"))
    values = lambda e: F.array_union(F.transform(F.array_distinct(F.array_compact(e["value"])), lambda v: F.concat(F.lit("="), v)), F.array(F.lit("-")))
    conds = F.transform(held, lambda e: F.struct(e["key"].alias("field"), values(e).alias("values")))
    table = table.select("template_id", "t", F.col("t.alert_type").alias("_type"), conds.alias("conds"))
    # a condition that many templates share tells little: a template is only looked up by its rarest one
    told = table.select("template_id", "_type", F.explode("conds").alias("c")).select("template_id", "_type", "c.field", F.explode("c.values").alias("value"))
    held_by = told.filter("value != '-'").groupBy("_type", "field", "value").agg(F.count(F.lit(1)).alias("_n"))
    cost = told.join(held_by, ["_type", "field", "value"], "left").groupBy("template_id", "field").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"))
    rarest = cost.groupBy("template_id").agg(F.min(F.struct("_n", "field")).alias("o")).select("template_id", F.col("o.field").alias("_by"))
    always = F.array(token(F.lit(""), F.lit("")))
    chosen = F.flatten(F.transform(F.filter("conds", lambda c: c["field"] == F.col("_by")), lambda c: F.transform(c["values"], lambda v: token(c["field"], v))))
    index = table.join(rarest, "template_id", "left").select("t", "_type", "conds", F.explode(F.when(F.size("conds") == 0, always).otherwise(chosen)).alias("k")).select("t", "_type", "conds", "k.field", "k.value")
    typed = alerts.withColumn("router_type", router_type(F.col("alert_type")))
    marks = {f"_m{k}": _known(F.col(f)) for k, f in enumerate(fields)}
    typed = typed.withColumns({"_type": F.col("router_type"), **marks})
    combination = ["_type", *marks]
    seen = typed.select(*combination).filter(F.col("_type").isNotNull()).distinct()
    tokens = F.array(token(F.lit(""), F.lit("")), *[token(F.lit(f), F.col(m)) for f, m in zip(fields, marks)])
    met = seen.select(*combination, F.explode(tokens).alias("k")).select(*combination, "k.field", "k.value").join(index, ["_type", "field", "value"])
    known = F.create_map(F.lit(""), F.lit(""), *[x for f, m in zip(fields, marks) for x in (F.lit(f), F.col(m))])
    every = F.forall("conds", lambda c: F.array_contains(c["values"], F.element_at(known, c["field"])))
    lists = met.filter(every).groupBy(*combination).agg(F.array_sort(F.collect_list("t")).alias("_hits"))
    shown = lambda hits: F.transform(hits, lambda t: F.struct(*[t[c].alias(c) for c in _SHOWN]))
    spare_ids = [DEFAULT_FALLBACK, *FALLBACKS.values()]
    fallback = table.filter(F.col("template_id").isin(spare_ids)).select(F.col("template_id").alias("_spare"), F.array("t").alias("_fallback"))
    joined = typed.withColumn("_spare", _fallback_id()).join(lists, combination, "left").join(fallback, "_spare", "left")
    none = F.array().cast(lists.schema["_hits"].dataType)
    return joined.withColumn("matched", shown(F.coalesce("_hits", "_fallback", none))).drop("_hits", "_fallback", "_spare", *combination)


def _fallback_id() -> Column:
    out = F.lit(DEFAULT_FALLBACK)
    for kind, template_id in FALLBACKS.items():
        out = F.when(F.col("router_type") == kind, template_id).otherwise(out)
    return out


def router_type(alert_type: Column) -> Column:
    """Alert types of the alert table as routing types; unknown ones give null."""
    return (
        F.when(alert_type.isin("defacement", "defacement_detected"), "defacement")
        .when(alert_type.isin("site_down", "system_error", "benign_change"), alert_type)
    )


def matched_templates(alerts: DataFrame, templates=DEFAULT_TEMPLATES) -> DataFrame:
    """Adds ``router_type`` and ``matched``: templates for the alert by priority.

    A null severity satisfies every condition. An alert that matches nothing
    gets the fallback template of its type. ``templates`` are records or a table.
    """
    table = _as_table(alerts, templates)
    if table is not None:
        return matched_by_index(alerts, table)
    typed = alerts.withColumn("router_type", router_type(F.col("alert_type")))
    everything = _literal(templates)

    def fits(template: Column) -> Column:
        free = (F.size(template["severities"]) == 0) | F.col("severity").isNull()
        return (template["alert_type"] == F.col("router_type")) & (
            free | F.array_contains(template["severities"], F.col("severity"))
        )

    fallback_id = _fallback_id()
    hits = typed.withColumn("_hits", F.filter(everything, fits))
    fallback = F.filter(everything, lambda t: t["template_id"] == fallback_id)
    return hits.withColumn("matched", F.when(F.size("_hits") > 0, F.col("_hits")).otherwise(fallback)).drop("_hits")


def route_alerts(alerts: DataFrame, templates=DEFAULT_TEMPLATES) -> DataFrame:
    """Every alert with its templates by priority and the union of their targets."""
    routed = matched_templates(alerts, templates)
    return routed.withColumns(
        {
            "template_ids": F.col("matched.template_id"),
            "channels": F.array_sort(F.array_distinct(F.flatten("matched.channels"))),
            "users": F.array_sort(F.array_distinct(F.flatten("matched.users"))),
        }
    ).drop("matched")


def throttle_notifications(
    alerts: DataFrame, templates=DEFAULT_TEMPLATES, slice_seconds: int = 86_400
) -> DataFrame:
    """One row per alert and template with ``should_send``.

    Every routed alert updates the tracking of its key, so the gap to the
    previous alert of the key decides. Tracking older than 24 hours is dropped.
    """
    keyed = alerts.withColumn("notification_key", F.concat_ws("_", "alert_type", "website_id"))
    traced = lag_over(
        keyed, ["notification_key"], ["created_at", "id"], time_slice("created_at", slice_seconds),
        {"previous_at": F.col("created_at")},
    )
    gap = seconds_between("previous_at", "created_at")
    rows = matched_templates(traced, templates).withColumn("_t", F.explode("matched"))
    minutes = F.col("_t.throttle_minutes")
    free = (minutes <= 0) | F.col("previous_at").isNull() | (gap >= minutes * 60) | (gap >= 86_400)
    return rows.select("id", "notification_key", "created_at", "_t.template_id", free.alias("should_send"))


def escalations_due(alerts: DataFrame, as_of: str, templates=DEFAULT_TEMPLATES) -> DataFrame:
    """Open alerts whose escalation time has come, per escalating template."""
    rows = matched_templates(alerts.filter(F.col("status") == "open"), templates).withColumn("_t", F.explode("matched"))
    due = F.col("created_at") + F.make_dt_interval(mins=F.col("_t.escalation_minutes"))
    return (
        rows.filter(F.col("_t.escalation_minutes") > 0)
        .select("id", "_t.template_id", due.alias("escalate_at"))
        .filter(F.col("escalate_at") <= at(as_of))
    )


def template_stats(alerts: DataFrame, as_of: str, templates=DEFAULT_TEMPLATES) -> DataFrame:
    """Targets of each template and its notifications of the last 24 hours."""
    recent = alerts.filter((F.col("created_at") > before(as_of, 24)) & (F.col("created_at") <= at(as_of)))
    sent = (
        matched_templates(recent, templates)
        .select(F.explode("matched.template_id").alias("template_id"))
        .groupBy("template_id")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    table = _as_table(alerts, templates)
    if table is None:
        known = alerts.sparkSession.range(1).select(F.explode(_literal(templates)).alias("_t"))
    else:
        known = table.select(F.struct(*[c for c in table.columns if c not in ("conditions", "position")]).alias("_t"))
    return known.select(
        "_t.template_id", "_t.alert_type", "_t.priority", F.size("_t.channels").alias("n_channels"),
        F.size("_t.users").alias("n_users"), "_t.throttle_minutes", "_t.escalation_minutes",
    ).join(sent, "template_id", "left").select(
        "template_id", "alert_type", "priority", "n_channels", "n_users",
        F.coalesce("_n", F.lit(0)).alias("recent_notifications_24h"), "throttle_minutes", "escalation_minutes",
    )


def delivery_batches(alerts: DataFrame, batch_size: int = 10, slice_seconds: int = 3600) -> DataFrame:
    """One row per message and channel, numbered in batches of messages by time."""
    numbered = running_sum(
        route_alerts(alerts), [], ["created_at", "id"], time_slice("created_at", slice_seconds), {"_n": F.lit(1)}
    )
    return numbered.select(
        "id", F.explode("channels").alias("channel"), F.floor((F.col("_n") - 1) / batch_size).alias("batch_no")
    )


def delivery_stats(deliveries: DataFrame) -> DataFrame:
    """Totals of sent, failed and retried messages (``success``, ``attempts``)."""
    return deliveries.agg(
        F.count_if("success").alias("messages_sent"),
        F.count_if(~F.col("success")).alias("messages_failed"),
        F.count_if(F.col("attempts") > 1).alias("messages_retried"),
    )


def alert_targets(config: DataFrame) -> DataFrame:
    """Targets per alert type, split into channels (``#``) and users (``@``).

    ``targets`` is the plain list form; ``channels`` and ``users`` hold the
    structured form and win when given.
    """

    def marked(mark: str) -> Column:
        return F.filter("targets", lambda x: F.startswith(x, F.lit(mark)))

    empty = F.array().cast("array<string>")
    return config.withColumns(
        {
            "channels": F.coalesce("channels", marked("#"), empty),
            "users": F.coalesce("users", marked("@"), empty),
        }
    ).drop("targets")
