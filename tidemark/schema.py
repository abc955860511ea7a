"""Table schemas, key columns and the check on names that reach SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = [T.StructField("security_id", T.StringType(), False), T.StructField("fiscal_year", T.IntegerType(), False), T.StructField("period", T.StringType(), False), T.StructField("end_date", T.DateType(), False), T.StructField("accepted_date", T.DateType(), False), T.StructField("filing_date", T.DateType(), False)]

#: Value columns of the three statements.
FIELDS = {
    "income_statement": ["revenue", "gross_profit", "ebitda", "ebit", "net_income", "eps_diluted"],
    "balance_sheet": ["total_assets", "total_liabilities", "total_equity", "cash_and_equivalents", "current_assets", "current_liabilities", "long_term_debt"],
    "cashflow": ["operating_cash_flow", "investing_cash_flow", "financing_cash_flow", "capital_expenditure", "free_cash_flow"],
}
#: Columns that identify one version of one statement, and those that are not values.
VERSION_KEY = ["security_id", "fiscal_year", "period", "accepted_date", "end_date"]
NOT_VALUES = [*VERSION_KEY, "filing_date"]

TABLES = {name: T.StructType(_KEY + [T.StructField(c, T.DoubleType()) for c in fields]) for name, fields in FIELDS.items()}
TABLES |= {
    "securities": T.StructType([T.StructField("security_id", T.StringType(), False), T.StructField("symbol", T.StringType(), False), T.StructField("cik", T.StringType(), False)] + [T.StructField(c, T.StringType()) for c in ("sector", "industry", "country", "exchange")]),
    "analyst_estimates": T.StructType([T.StructField("security_id", T.StringType(), False), T.StructField("target_date", T.DateType(), False), T.StructField("pulled_at", T.TimestampNTZType(), False), T.StructField("metric", T.StringType(), False), T.StructField("consensus", T.DoubleType()), T.StructField("n_analysts", T.IntegerType())]),
    "prices": T.StructType([T.StructField("security_id", T.StringType(), False), T.StructField("date", T.DateType(), False)] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close")] + [T.StructField("volume", T.LongType())]),
}
KEYS = {name: VERSION_KEY for name in FIELDS} | {"securities": ["security_id"], "analyst_estimates": ["security_id", "target_date", "pulled_at", "metric"], "prices": ["security_id", "date"]}

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,62}")


def check_name(name: str) -> str:
    """The name, if it is a plain identifier; ValueError otherwise."""
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise ValueError(f"not a plain identifier: {name!r}")
    return name


def check_table(name: str) -> str:
    """The name, if it is one of the six tables."""
    if check_name(name) not in TABLES:
        raise ValueError(f"unknown table: {name!r}")
    return name


def check_statement(name: str) -> str:
    """The name, if it is one of the three statements."""
    if check_name(name) not in FIELDS:
        raise ValueError(f"not a statement table: {name!r}")
    return name


def value_columns(table: DataFrame) -> list[str]:
    """The value columns a statement has, whichever were added to it."""
    return [check_name(c) for c in table.columns if c not in NOT_VALUES]


def no_nan(table: DataFrame) -> DataFrame:
    """NaN becomes null: null is the only missing value."""
    return table.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in table.schema])


def assert_unique(table: DataFrame, keys: list[str]) -> None:
    """ValueError if two rows share a key."""
    twice = table.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated key {[twice[0][k] for k in keys]}")


def empty(spark, name: str) -> DataFrame:
    """An empty table of the schema."""
    return spark.createDataFrame([], TABLES[check_table(name)])
