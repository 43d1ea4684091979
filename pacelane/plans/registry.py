"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacelane.plans.views import with_views
from pacelane.session import ship_package
from pacelane.testbed import Testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SURVEY: dict[str, str] = {}


def query(name: str, survey: str, sql: str | None = None):
    """Register ``f(testbed) -> DataFrame`` under ``name`` for an inventory row."""

    def wrap(build: Callable[[Testbed], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return build(Testbed(spark, folder))

        QUERIES[name] = run
        SURVEY[name] = survey
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return build

    return wrap


def r6(value: str | Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero, so two engines' sums compare equal."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, digits) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r6(n, digits) for n in names})
