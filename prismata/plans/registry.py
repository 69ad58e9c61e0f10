"""Where queries register: a name, a DataFrame plan, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.projection import Repo, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(plan: Callable[[Repo], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(Repo(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return plan

    return add
