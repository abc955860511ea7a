"""Point-in-time access: what was known about a security at a date.

Every operator takes a grid of (security_id, as_of_date) rows and answers all of them in one plan: an
equi-join on the security with the knowledge-time condition as residual, then one hash aggregation.
Dense grids use :func:`intervals`, which keeps the join at one match per period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import check_name, value_columns

GRID = ["security_id", "as_of_date"]
#: Metrics that can be forecast.
METRICS = ("eps_diluted", "ebitda", "ebit")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}: {metric!r}")
    return metric


def last_known(value: str, order: Column) -> Column:
    """The value of the row greatest by ``order`` among those where it is not null."""
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), order))


def keys_of(grid: DataFrame) -> DataFrame:
    """The grid's distinct points; candidates may repeat them."""
    return grid.select(*GRID).distinct()


def visible(grid: DataFrame, table: DataFrame, known: str = "accepted_date") -> DataFrame:
    """The rows of ``table`` that were known at each grid point."""
    return keys_of(grid).join(table, "security_id").where(F.col(known) <= F.col("as_of_date"))


def latest_row(grid: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """The whole latest version: greatest accepted, end and filing date; of several, greatest fiscal year and period."""
    if not columns:
        raise ValueError("columns must not be empty")
    picked = F.struct(*[F.col(check_name(c)) for c in columns])
    best = visible(grid, table).groupBy(*GRID).agg(F.max_by(picked, F.struct("accepted_date", "end_date", "filing_date", "fiscal_year", "period")).alias("row"))
    return best.select(*GRID, "row.*")


def series(grid: DataFrame, table: DataFrame) -> DataFrame:
    """Field-level state at each grid point: per period and end date, each field's latest non-null value.

    Carries the greatest accepted date and that version's filing date. One aggregation; columns that
    nothing reads are pruned from it.
    """
    by = F.col("accepted_date")
    fields = [last_known(c, by).alias(c) for c in value_columns(table)]
    got = visible(grid, table).groupBy(*GRID, "fiscal_year", "period", "end_date")
    return got.agg(F.max("accepted_date").alias("accepted_date"), F.max_by("filing_date", "accepted_date").alias("filing_date"), *fields)


def intervals(table: DataFrame) -> DataFrame:
    """Each version's field-level state with the interval [known_from, known_to) in which it is the latest."""
    w = Window.partitionBy("security_id", "fiscal_year", "period", "end_date").orderBy("accepted_date")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = [F.last(c, ignorenulls=True).over(upto).alias(c) for c in value_columns(table)]
    return table.select("security_id", "fiscal_year", "period", "end_date", "accepted_date", "filing_date", *filled, F.col("accepted_date").alias("known_from"), F.lead("accepted_date").over(w).alias("known_to"))


def series_dense(grid: DataFrame, table: DataFrame) -> DataFrame:
    """The same as :func:`series` for dense grids: one match per grid point and period."""
    spans = intervals(table)
    met = keys_of(grid).join(spans, "security_id").where((F.col("known_from") <= F.col("as_of_date")) & (F.col("known_to").isNull() | (F.col("as_of_date") < F.col("known_to"))))
    return met.drop("known_from", "known_to")


def consensus(grid: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates pulled up to the end of the day, whole seconds: 23:59:59 is in, what follows it is not."""
    end = F.expr("cast(as_of_date as timestamp_ntz) + interval '23:59:59' hour to second")
    return keys_of(grid).join(estimates, "security_id").where(F.col("pulled_at") <= end)


def consensus_pick(grid: DataFrame, estimates: DataFrame, metric: str, farthest: bool = False) -> DataFrame:
    """One estimate a grid point: the latest pull of the nearest target not before the date.

    ``farthest`` picks as the original did: the oldest pull of the farthest target.
    """
    name = {"eps_diluted": "eps"}.get(metric, metric)
    seen = consensus(grid, estimates).where(F.col("metric") == (metric if farthest else name))
    if farthest:
        return seen.groupBy(*GRID).agg(F.max_by("consensus", F.struct("target_date", -F.unix_micros(F.col("pulled_at").cast("timestamp")))).alias("consensus"))
    ahead = seen.where(F.col("target_date") >= F.col("as_of_date"))
    return ahead.groupBy(*GRID).agg(F.min_by("consensus", F.struct("target_date", -F.unix_micros(F.col("pulled_at").cast("timestamp")))).alias("consensus"))


def prices(grid: DataFrame, table: DataFrame) -> DataFrame:
    """Prices up to each date."""
    return visible(grid, table, "date")


def sectors(grid: DataFrame, securities: DataFrame) -> DataFrame:
    """Each grid point's sector; blank is null. Not point-in-time: sectors have no versions."""
    known = securities.select("security_id", F.expr("nullif(trim(sector), '')").alias("sector"))
    return keys_of(grid).join(known, "security_id", "left")


def first_disclosures(income: DataFrame, metric: str) -> DataFrame:
    """(security_id, fiscal_year, first_accepted, end_date, value): when each year's metric first became known."""
    named = F.col(check_name(metric))
    known = income.where((F.col("period") == "FY") & named.isNotNull())
    # The least accepted date, and of its rows the greatest end date.
    order = F.struct(F.col("accepted_date"), -F.datediff("end_date", F.lit("1970-01-01")))
    first = known.groupBy("security_id", "fiscal_year").agg(F.min("accepted_date").alias("first_accepted"), F.min_by(F.struct("end_date", named.alias("value")), order).alias("at"))
    return first.select("security_id", "fiscal_year", "first_accepted", "at.end_date", "at.value")


def next_target(grid: DataFrame, income: DataFrame, metric: str) -> DataFrame:
    """The smallest fiscal year whose first disclosure is strictly after the date: target_fy, target_accepted_date, target_value."""
    first = first_disclosures(income, check_metric(metric))
    ahead = keys_of(grid).join(first, "security_id").where(F.col("first_accepted") > F.col("as_of_date"))
    best = ahead.groupBy(*GRID).agg(F.min_by(F.struct("fiscal_year", "first_accepted", "value"), "fiscal_year").alias("t"))
    return best.select(*GRID, F.col("t.fiscal_year").alias("target_fy"), F.col("t.first_accepted").alias("target_accepted_date"), F.col("t.value").alias("target_value"))


def last_actual(grid: DataFrame, income: DataFrame, metric: str) -> DataFrame:
    """The latest full-year value known at the date: greatest end, then accepted date."""
    named = F.col(check_metric(metric))
    known = income.where((F.col("period") == "FY") & named.isNotNull())
    return visible(grid, known).groupBy(*GRID).agg(F.max_by(named, F.struct("end_date", "accepted_date")).alias("naive_baseline"))


def annual_panel(income: DataFrame, securities: DataFrame, metric: str) -> DataFrame:
    """First-disclosed annual values with their symbols."""
    return first_disclosures(income, metric).join(securities.select("security_id", "symbol"), "security_id").select("symbol", "fiscal_year", "end_date", "first_accepted", "value")


def filing_latency(income: DataFrame, metric: str) -> DataFrame:
    """Days from a year's end to its first disclosure."""
    return first_disclosures(income, metric).select("security_id", "fiscal_year", F.datediff("first_accepted", "end_date").cast("long").alias("latency_days"))
