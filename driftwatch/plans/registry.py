"""Registry of runnable queries and the SQL text that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftwatch.plans.views import Fixtures, view_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None, recursive: bool = False):
    """Register ``fn(fixtures)`` as a query, with an optional checking statement.

    ``views`` names the derived input views the SQL uses; they are inlined as
    common table expressions because only the base tables are registered.
    ``sql`` may itself begin with ``, more AS (...)`` expressions.
    """

    def wrap(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = assemble(sql, views, recursive)
        return fn

    return wrap


def assemble(sql: str, views: tuple[str, ...], recursive: bool = False) -> str:
    body = sql.strip()
    ctes = view_ctes(views)
    if body.startswith(","):
        body = body[1:].strip()
        if not ctes:
            return f"WITH {'RECURSIVE ' if recursive else ''}{body}"
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{body}"
    return f"WITH {ctes}\n{body}" if ctes else body
