"""All registered queries of the point-in-time engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import features
from tidemark.plans import feature_queries, metric_queries, pit_queries, source_queries
from tidemark.plans.views import Views

MODULES = [pit_queries, feature_queries, metric_queries, source_queries]


def _run(query: Callable[[Views], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(Views(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of the trailing twelve months at each fiscal year's first disclosure."""
    v = Views(spark, sf_dir)
    return features.matrix(pit_queries.year_grid(v), {"income_statement": v.income()}, features.BUILTIN.select(["revenue_ttm"]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, query) for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
