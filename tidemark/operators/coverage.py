"""Coverage audits: how much of what should be known is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import Registry
from tidemark.schema import value_columns


def statement_coverage(table: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled, total, coverage) of the latest field-level state of each security, year and period."""
    known = value_columns(table)
    state = table.groupBy("security_id", "fiscal_year", "period", "end_date").agg(F.max("accepted_date").alias("accepted_date"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("accepted_date"))).alias(c) for c in known])
    order = F.struct("end_date", "accepted_date")
    last = state.groupBy("security_id", "fiscal_year", "period").agg(F.max_by(F.struct(*known), order).alias("r")).select("r.*")
    counts = last.agg(F.count("*").alias("total"), *[F.count(c).alias(c) if c in known else F.lit(0).cast("long").alias(c) for c in fields])
    stack = ", ".join(f"'{c}', {c}" for c in fields)
    return counts.selectExpr("total", f"stack({len(fields)}, {stack}) as (field, filled)").select("field", "filled", "total", F.expr("try_divide(cast(filled as double), total)").alias("coverage"))


def feature_coverage(matrix: DataFrame, registry: Registry) -> DataFrame:
    """(feature, filled, total, coverage, floor, below) in one pass over the matrix."""
    names = registry.names()
    counts = matrix.agg(F.count("*").alias("total"), *[F.count(n).alias(n) for n in names])
    stack = ", ".join(f"'{n}', {n}, {registry[n].min_coverage}D" for n in names)
    tall = counts.selectExpr("total", f"stack({len(names)}, {stack}) as (feature, filled, floor)")
    share = F.expr("try_divide(cast(filled as double), total)")
    return tall.select("feature", "filled", "total", share.alias("coverage"), "floor", F.coalesce(share < F.col("floor"), F.lit(True)).alias("below"))
