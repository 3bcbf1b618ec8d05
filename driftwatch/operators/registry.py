"""The site registry: registration, updates, activation, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.html import host
from driftwatch.sources.tables import latest_values, with_defaults

# Accepted address form.
URL_PATTERN = (
    r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|"
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"
)


def site_id(url: Column) -> Column:
    """Identifier of a newly registered site."""
    return F.substring(F.sha2(url, 256), 1, 16)


def register_sites(sites: DataFrame, candidates: DataFrame, as_of: Column) -> DataFrame:
    """New site rows for the addresses that are not registered yet.

    ``candidates`` has ``url``, ``name`` and ``check_interval_seconds`` (both
    may be null) and may repeat addresses; the smallest name wins. The name
    defaults to the host of the address.
    """
    fresh = candidates.groupBy("url").agg(
        F.min("name").alias("name"), F.min("check_interval_seconds").alias("check_interval_seconds")
    ).join(sites.select("url"), "url", "left_anti")
    return fresh.select(
        site_id(F.col("url")).alias("id"),
        "url",
        F.coalesce("name", host(F.col("url"))).alias("name"),
        F.coalesce("check_interval_seconds", F.lit(300)).alias("check_interval_seconds"),
        F.lit(True).alias("is_active"),
        as_of.alias("created_at"),
    )


def new_snapshots(captures: DataFrame) -> DataFrame:
    """Snapshot rows ready to append: status 200 and text length by default."""
    return with_defaults(
        captures, {"status_code": F.lit(200), "content_length": F.length("content_text").cast("int")}
    )


def new_alerts(raised: DataFrame) -> DataFrame:
    """Alert rows ready to append with their default severity and status."""
    return with_defaults(
        raised, {"severity": F.lit("medium"), "status": F.lit("open"), "notifications_sent": F.lit(0)}
    )


def update_sites(sites: DataFrame, patches: DataFrame, snaps: DataFrame, as_of: Column, order: list[Column] | None = None) -> DataFrame:
    """Apply attribute patches and move ``last_checked_at`` to the newest snapshot.

    ``patches(id, name, check_interval_seconds, is_active)`` may have nulls for
    attributes to keep; of several patches of a site each attribute takes the value of the first
    patch in ``order`` (newest first) that has one, without an order its largest value.
    ``updated_at`` is stamped on patched sites and stays on the others.
    """
    fields = ["name", "check_interval_seconds", "is_active"]
    one = patches.groupBy("id").agg(*[F.max(f).alias(f) for f in fields]) if order is None else latest_values(patches, "id", fields, order)
    side = one.select("id", *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_hit"))
    sites = with_defaults(sites, {"updated_at": F.lit(None).cast("timestamp_ntz")})
    seen = snaps.groupBy(F.col("website_id").alias("id")).agg(F.max("captured_at").alias("_seen"))
    joined = sites.join(side, "id", "left").join(seen, "id", "left")
    return joined.withColumns(
        {
            **{f: F.coalesce(f"_new_{f}", f) for f in fields},
            "last_checked_at": F.coalesce(F.greatest("_seen", "last_checked_at"), F.col("last_checked_at")),
            "updated_at": F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at")),
        }
    ).drop("_hit", "_seen", *[f"_new_{f}" for f in fields])


def set_monitoring(sites: DataFrame, active: bool, ids: DataFrame | None = None) -> DataFrame:
    """Switch sites on or off; all of them if no ids are given.

    Result per site or requested id: ``changed``, ``unchanged`` or ``not_found``
    with the state after the switch.
    """
    state = F.when(F.col("is_active") == active, "unchanged").otherwise("changed")
    if ids is None:
        return sites.select("id", state.alias("outcome"), F.lit(active).alias("is_active"))
    asked = ids.select("id").distinct()
    joined = asked.join(sites.select("id", "is_active"), "id", "left")
    found = F.col("is_active").isNotNull()
    return joined.select(
        "id", F.when(found, state).otherwise("not_found").alias("outcome"), F.when(found, F.lit(active)).alias("is_active")
    )


def validate_sites(sites: DataFrame) -> DataFrame:
    """One row per issue: missing or bad address, bad interval, bad identifier."""
    url, sid = F.trim(F.coalesce("url", F.lit(""))), F.trim(F.coalesce(F.col("id").cast("string"), F.lit("")))
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    fields = F.size(F.split(F.trim("interval"), r"\s+"))
    issues = F.array(
        F.when(url == "", "missing url").when(~full.rlike(URL_PATTERN), "invalid url"),
        F.when(F.col("interval").isNotNull() & (fields != 5), "invalid interval"),
        F.when(sid == "", "missing id")
        .when(F.length(sid) < 3, "id too short")
        .when(F.length(sid) > 100, "id too long")
        .when(~sid.rlike("^[a-zA-Z0-9_-]+$"), "id has invalid characters"),
    )
    rows = sites.select("id", "url", F.explode_outer(F.array_compact(issues)).alias("issue"))
    return rows.filter(F.col("issue").isNotNull())
