"""Imports every query module and exposes the filled registry."""

from __future__ import annotations

import importlib

from driftwatch.plans.registry import CHECKS, QUERIES

MODULES = (
    "history_queries",
    "metrics_queries",
    "alert_queries",
    "text_queries",
    "rule_queries",
    "ensemble_queries",
    "feedback_queries",
    "vector_queries",
    "page_queries",
    "registry_queries",
    "visual_queries",
    "stream_queries",
)


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"driftwatch.plans.{module}")


def queries():
    _load()
    return dict(QUERIES)


def checks():
    _load()
    return dict(CHECKS)
