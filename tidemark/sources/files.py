"""Readers of filings, quotes, estimates and lists. All have explicit schemas; malformed entries are passed over."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>"
FACTS = f"cik long, entityName string, facts struct<`us-gaap`:map<string,struct<label:string,description:string,units:map<string,array<{ENTRY}>>>>>"
SUBMISSIONS = "cik string, tickers array<string>, exchanges array<string>, fiscalYearEnd string, filings struct<recent:struct<accessionNumber:array<string>,filingDate:array<string>,form:array<string>>>"
# The forms that carry statements.
FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A")
QUOTES = "Date date, `Adj Close` double, Close double, High double, Low double, Open double, Volume long"


def facts(spark: SparkSession, path: str, security_id: str | None = None, since: dt.date | None = None) -> DataFrame:
    """The facts of company files: one row an entry; without a known end, filing date and value an entry is passed over.

    ``security_id`` names the security; without it, the zero-padded cik does. ``since`` keeps what was filed on that day or later.
    """
    raw = spark.read.schema(FACTS).option("multiLine", True).json(path)
    who = F.lit(security_id) if security_id else F.lpad(F.col("cik").cast("string"), 10, "0")
    concepts = raw.select(who.alias("security_id"), F.explode(F.map_entries("facts.us-gaap")).alias("c"))
    units = concepts.select("security_id", F.col("c.key").alias("concept"), F.explode(F.map_entries("c.value.units")).alias("u"))
    entries = units.select("security_id", "concept", F.col("u.key").alias("unit"), F.explode("u.value").alias("e"))
    day = lambda c: F.expr(f"try_to_date(e.{c}, 'yyyy-MM-dd')")
    rows = entries.select("security_id", "concept", day("start").alias("start"), day("end").alias("end"), day("filed").alias("filed"), F.coalesce("e.fy", F.lit(0)).alias("fy"), F.col("e.fp").alias("fp"), F.col("e.form").alias("form"), F.col("e.val").alias("value"), "unit")
    kept = rows.where("`end` is not null and filed is not null and value is not null and form is not null")
    return kept if since is None else filed_since(kept, since)


def filed_since(rows: DataFrame, since: dt.date) -> DataFrame:
    """Facts filed on a day or later."""
    return rows.where(F.col("filed") >= F.lit(since))


def filings(spark: SparkSession, path: str) -> DataFrame:
    """(cik, form, accession, filing_date) of annual and quarterly filings; unequal lists are an error."""
    raw = spark.read.schema(SUBMISSIONS).option("multiLine", True).json(path).select("cik", "filings.recent.*")
    equal = (F.size("form") == F.size("accessionNumber")) & (F.size("form") == F.size("filingDate"))
    checked = raw.withColumn("form", F.when(equal, F.col("form")).otherwise(F.raise_error(F.lit("the lists of filings differ in length")).cast("array<string>")))
    each = checked.select("cik", F.explode(F.arrays_zip("form", "accessionNumber", "filingDate")).alias("f"))
    return each.select("cik", "f.form", F.col("f.accessionNumber").alias("accession"), F.expr("try_to_date(f.filingDate)").alias("filing_date")).where(F.col("form").isin(*FORMS))


def quotes(spark: SparkSession, path: str, start: dt.date, end: dt.date) -> DataFrame:
    """A quote file's rows from start to end, both in."""
    return spark.read.schema(QUOTES).option("header", True).option("enforceSchema", False).csv(path).where(F.col("Date").between(start, end))


def estimates(spark: SparkSession, path: str) -> DataFrame:
    """An estimate file's (period, avg, numberOfAnalysts), whatever further columns it has."""
    raw = spark.read.option("header", True).csv(path)
    first = raw.columns[0]
    return raw.select(F.col(f"`{first}`").alias("period"), F.expr("try_cast(avg as double)").alias("avg"), F.expr("cast(try_cast(numberOfAnalysts as double) as int)").alias("numberOfAnalysts"))


def info(spark: SparkSession, path: str, cik: str) -> DataFrame:
    """A company description's sector, industry, country and exchange."""
    raw = spark.read.schema("sector string, industry string, country string, exchange string").option("multiLine", True).json(path)
    return raw.select(F.lit(cik).alias("cik"), "sector", "industry", "country", "exchange")


def of_symbols(securities: DataFrame, symbols: list[str]) -> DataFrame:
    """The securities with one of the given symbols, by an IN-list that reaches the scan; none without symbols."""
    return securities.where(F.col("symbol").isin(list(symbols)))


def tickers(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, cik) of lines `TICKER,CIK`; blank lines and those that begin with # are passed over."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and v not like '#%'")
    parts = F.split("v", ",", 2)
    return lines.select(F.trim(parts[0]).alias("symbol"), F.trim(F.get(parts, F.lit(1))).alias("cik"))


def known_financials(spark: SparkSession, path: str) -> DataFrame:
    """Truth rows (cik, fiscal_year, field, expected); a value that is missing without a stated reason is an error."""
    anchor = "struct<ticker:string,cik:string,fiscal_year:int,revenue_usd:double,net_income_usd:double,eps_diluted:double,revenue_skip_reason:string,net_income_skip_reason:string,eps_diluted_skip_reason:string>"
    raw = spark.read.schema(f"anchors array<{anchor}>").option("multiLine", True).json(path).select(F.explode("anchors").alias("a")).select("a.*")
    tall = raw.selectExpr("cik", "fiscal_year", "stack(3, 'revenue', revenue_usd, revenue_skip_reason, 'net_income', net_income_usd, net_income_skip_reason, 'eps_diluted', eps_diluted, eps_diluted_skip_reason) as (field, expected, reason)")
    bad = tall.where("expected is null and reason is null").limit(1).collect()
    if bad:
        raise ValueError(f"no value and no reason: {bad[0].cik} {bad[0].fiscal_year} {bad[0].field}")
    return tall.where("expected is not null").drop("reason")
