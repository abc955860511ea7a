"""As-of grids and the fold schedule."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ["security_id", "symbol", "as_of_date", "as_of_source"]


def _named(grid: DataFrame, securities: DataFrame) -> DataFrame:
    return grid.join(securities.select("security_id", "symbol"), "security_id").select(*COLUMNS)


def _tag(*parts) -> F.Column:
    return F.concat_ws(".", F.lit("income_statement"), *[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])


def filing_dates(income: DataFrame, securities: DataFrame) -> DataFrame:
    """Every date on which a period was filed. A date repeats for each period filed on it."""
    each = income.select("security_id", "fiscal_year", "period", F.col("accepted_date").alias("as_of_date")).distinct()
    return _named(each.withColumn("as_of_source", _tag(F.col("period"), F.col("fiscal_year"))), securities)


def fiscal_year_end(income: DataFrame, securities: DataFrame) -> DataFrame:
    """The first filing of each full year."""
    first = income.where("period = 'FY'").groupBy("security_id", "fiscal_year").agg(F.min("accepted_date").alias("as_of_date"))
    return _named(first.withColumn("as_of_source", _tag("FY", F.col("fiscal_year"))), securities)


def quarterly(income: DataFrame, securities: DataFrame) -> DataFrame:
    """The last filing of each period, full years among them."""
    last = income.groupBy("security_id", "fiscal_year", "period").agg(F.max("accepted_date").alias("as_of_date"))
    return _named(last.withColumn("as_of_source", _tag(F.col("period"), F.col("fiscal_year"))), securities)


def daily(securities: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Every day from start to end, both in."""
    day = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day")))
    each = securities.select("security_id", "symbol", day.alias("as_of_date"))
    return each.select("security_id", "symbol", "as_of_date", F.concat(F.lit("calendar."), F.col("as_of_date").cast("string")).alias("as_of_source"))


def audit(income: DataFrame, securities: DataFrame) -> DataFrame:
    """The last filing of each fiscal year's full-year figures."""
    last = income.where("period = 'FY'").groupBy("security_id", "fiscal_year").agg(F.max("accepted_date").alias("as_of_date"))
    return _named(last.withColumn("as_of_source", _tag("FY", F.col("fiscal_year"))), securities)


def panel(securities: DataFrame, first_year: int = 2018, last_year: int = 2024, month: int = 5, day: int = 15) -> DataFrame:
    """One date a year for every security."""
    each = securities.select("security_id", "symbol", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("year"))
    return each.select("security_id", "symbol", F.make_date("year", F.lit(month), F.lit(day)).alias("as_of_date"), F.concat(F.lit("panel."), F.col("year").cast("string")).alias("as_of_source"))


STRATEGIES = {"filing_dates": filing_dates, "fiscal_year_end": fiscal_year_end, "quarterly": quarterly}

#: Days on which a fold is cut; those of early in a year belong to the year before.
CUTS = (("05-15", 0), ("08-14", 0), ("11-15", 0), ("03-01", 1))


def folds(spark: SparkSession, start_year: int, end_year: int) -> DataFrame:
    """Expanding-window folds: four cutoffs a year; each window ends at the next cutoff. The first fold only trains."""
    if start_year > end_year:
        raise ValueError("start_year must not be after end_year")
    rows = sorted(dt.date.fromisoformat(f"{year + later}-{day}") for year in range(start_year, end_year + 1) for day, later in CUTS)
    cuts = spark.createDataFrame([(d,) for d in rows], "cutoff date")
    w = Window.orderBy("cutoff")  # four rows a year
    numbered = cuts.withColumn("fold_idx", F.row_number().over(w) - 1)
    ends = F.coalesce(F.lead("cutoff").over(w), F.lit(dt.date(end_year + 2, 1, 1)))
    return numbered.select("fold_idx", "cutoff", ends.alias("window_end"), F.col("cutoff").cast("string").alias("cutoff_label"), (F.col("fold_idx") == 0).alias("is_seed"))
