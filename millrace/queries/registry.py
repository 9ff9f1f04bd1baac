"""Named queries over the given tables, each with its check in plain SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.views import ctes, view

View = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, views: Sequence[str] = (), sql: str | None = None):
    """Register a function from a view lookup to a DataFrame."""

    def register(fn: Callable[[View], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda n: view(spark, sf_dir, n))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            if not views:
                CHECKS[name] = body
            elif body.startswith("WITH "):
                CHECKS[name] = ctes(*views).rstrip() + ",\n" + body[5:]
            else:
                CHECKS[name] = ctes(*views) + body
        return fn

    return register
