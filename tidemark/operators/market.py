"""Prices and analyst estimates: un-split quotes, estimate labels as dates, snapshots as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unsplit(prices: DataFrame, splits: DataFrame) -> DataFrame:
    """Quotes as they were traded: times all split ratios strictly after their day, volume divided by them.

    ``splits`` has security_id, date and ratio. The adjusted close stays as it is.
    """
    later = splits.select("security_id", F.to_date("date").alias("_on"), "ratio")
    factor = prices.select("security_id", "date").distinct().join(later, "security_id").where(F.col("_on") > F.col("date")).groupBy("security_id", "date").agg(F.product("ratio").alias("_f"))
    met = prices.join(factor, ["security_id", "date"], "left").withColumn("_f", F.coalesce("_f", F.lit(1.0)))
    quotes = {c: F.col(c) * F.col("_f") for c in ("open", "high", "low", "close")}
    return met.withColumns(quotes).withColumn("volume", F.bround(F.col("volume") / F.col("_f")).cast("long")).drop("_f").select(*prices.columns)


def snake_prices(raw: DataFrame, security_id: str) -> DataFrame:
    """A quote file's columns by our names."""
    names = {"Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}
    return raw.select(F.lit(security_id).alias("security_id"), *[F.col(f"`{a}`").cast("date" if b == "date" else "long" if b == "volume" else "double").alias(b) for a, b in names.items()])


def end_of_quarter(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def label_date(label: Column, anchor: Column) -> Column:
    """The date that an estimate's label means at an anchor date; null for unknown labels.

    0q and +1q are calendar quarters' ends, 0y and +1y Decembers' ends.
    """
    plain = F.lower(F.trim(label))
    year = lambda n: F.make_date(F.year(anchor) + n, F.lit(12), F.lit(31))
    return F.when(plain.isin("0q", "current quarter"), end_of_quarter(anchor)).when(plain.isin("+1q", "1q", "next quarter"), end_of_quarter(F.add_months(F.trunc(anchor, "quarter"), 3))).when(plain.isin("0y", "current year"), year(0)).when(plain.isin("+1y", "1y", "next year"), year(1))


def estimate_rows(raw: DataFrame, metric: str, security_id: Column, pulled_at: Column) -> DataFrame:
    """Estimates (period, avg, numberOfAnalysts) as rows of analyst_estimates; none without an average; no analysts is null."""
    dated = raw.select(security_id.alias("security_id"), label_date(F.col("period"), pulled_at.cast("date")).alias("target_date"), pulled_at.alias("pulled_at"), F.lit(metric).alias("metric"), F.col("avg").cast("double").alias("consensus"), F.expr("nullif(cast(numberOfAnalysts as int), 0)").alias("n_analysts"))
    return dated.where("target_date is not null and consensus is not null and not isnan(consensus)")


def with_metadata(securities: DataFrame, info: DataFrame) -> DataFrame:
    """Securities with the sector, industry, country and exchange that ``info`` (cik, ...) knows; nulls change nothing."""
    fields = ["sector", "industry", "country", "exchange"]
    new = info.groupBy("cik").agg(*[F.max(F.expr(f"nullif({c}, '')")).alias(f"_{c}") for c in fields])
    met = securities.join(new, "cik", "left")
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in securities.columns])


def with_new_securities(securities: DataFrame, tickers: DataFrame) -> DataFrame:
    """Securities and those of ``tickers`` (symbol, cik) whose cik they lack, under ids made from the cik."""
    lacking = tickers.dropDuplicates(["cik"]).join(securities.select("cik"), "cik", "left_anti")
    digest = F.sha2("cik", 256)
    made = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))
    return securities.unionByName(lacking.select(made.alias("security_id"), "symbol", "cik"), allowMissingColumns=True)
