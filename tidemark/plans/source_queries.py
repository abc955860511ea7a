"""Queries that write through a sink or as a source's files, read back, and give what came back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import folders
from tidemark.operators import market, runs
from tidemark.plans.pit_queries import year_grid
from tidemark.plans.views import Views, sql
from tidemark.sources import files, sinks

SYMBOLS = ["NATION_3", "NATION_14", "NATION_21"]
SINCE = dt.date(1996, 6, 30)


def quote_files(v: Views) -> DataFrame:
    """All quotes as a quote file, read from 1996-03-01 to 2000-12-31."""
    where = folders.passing_folder(v.spark, "quotes")
    raw = v.prices().select(F.col("date").alias("Date"), F.col("adj_close").alias("Adj Close"), F.col("close").alias("Close"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("open").alias("Open"), F.col("volume").alias("Volume"))
    raw.write.option("header", True).csv(f"{where}/q")
    return market.snake_prices(files.quotes(v.spark, f"{where}/q", dt.date(1996, 3, 1), dt.date(2000, 12, 31)), "all")


def estimate_files(v: Views) -> DataFrame:
    where = folders.passing_folder(v.spark, "estimates")
    v.raw_estimates().select("period", "avg", "numberOfAnalysts", "metric").write.option("header", True).csv(f"{where}/e")
    return files.estimates(v.spark, f"{where}/e")


def ticker_files(v: Views) -> DataFrame:
    where = folders.passing_folder(v.spark, "tickers")
    lines = v.securities().select(F.concat(F.lit(" "), "symbol", F.lit(" , "), "cik").alias("value"))
    lines.union(v.spark.createDataFrame([("# a remark",), ("",), ("   ",)], "value string")).write.text(f"{where}/t")
    return files.tickers(v.spark, f"{where}/t")


def company_files(v: Views) -> DataFrame:
    """Revenue as one facts file a security, read back as facts filed on a day or later."""
    where = folders.passing_folder(v.spark, "facts")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    entry = F.struct(day("end_date").alias("end"), F.col("revenue").alias("val"), F.col("fiscal_year").alias("fy"), F.col("period").alias("fp"), F.lit("10-K").alias("form"), day("filing_date").alias("filed"))
    each = v.reported_income().groupBy("security_id").agg(F.collect_list(entry).alias("entries"))  # one company's file
    units = F.create_map(F.lit("USD"), F.col("entries"))
    concept = F.create_map(F.lit("Revenues"), F.struct(F.lit("Revenue").alias("label"), units.alias("units")))
    body = F.to_json(F.struct(F.col("security_id").cast("long").alias("cik"), F.lit("x").alias("entityName"), F.struct(concept.alias("us-gaap")).alias("facts")))
    each.select("security_id", body.alias("value")).repartition("security_id").write.partitionBy("security_id").text(f"{where}/f")
    told = files.facts(v.spark, f"{where}/f/*", since=SINCE)
    return told.select(F.col("security_id").alias("cik"), "concept", "unit", "end", "filed", "fy", "fp", "value")


def appended(v: Views) -> DataFrame:
    """The income statements appended to a new warehouse by name, and read back."""
    store = sinks.Warehouse(v.spark, f"{folders.passing_folder(v.spark, 'warehouse')}/w")
    store.create()
    store.append("income_statement", v.reported_income().select("net_income", "revenue", "security_id", "fiscal_year", "period", "end_date", "accepted_date", "filing_date"))
    return store.read("income_statement").select("security_id", "fiscal_year", "period", "end_date", "accepted_date", "revenue", "net_income", F.col("ebit").isNull().alias("no_ebit"))


def replaced(v: Views) -> DataFrame:
    """A warehouse's securities written anew with what is known of their sector: a partial update."""
    store = sinks.Warehouse(v.spark, f"{folders.passing_folder(v.spark, 'warehouse')}/w")
    store.create()
    store.append("securities", v.securities().withColumns({"sector": F.lit(None).cast("string"), "exchange": F.lit("OLD")}))
    info = v.securities().where("sector <> '  '").select("cik", "sector", F.lit("").alias("industry"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("exchange"))
    store.replace("securities", market.with_metadata(store.read("securities"), info))
    return store.read("securities").select("security_id", "symbol", "cik", "sector", "industry", "country", "exchange")


def new_securities(v: Views) -> DataFrame:
    known = v.securities().where("cast(security_id as int) < 10").select("security_id", "symbol", "cik")
    return market.with_new_securities(known, v.securities().select("symbol", "cik"))


def matrix_files(v: Views) -> DataFrame:
    """A matrix as CSV and as Parquet, joined again."""
    where = folders.passing_folder(v.spark, "matrix")
    rows = year_grid(v).select("security_id", "as_of_date").distinct().withColumn("x", F.datediff("as_of_date", F.lit(dt.date(1990, 1, 1))) / 8)
    sinks.write_matrix(rows, f"{where}/m.csv")
    sinks.write_matrix(rows, f"{where}/m.parquet")
    one = v.spark.read.schema("security_id string, as_of_date date, x double").option("header", True).csv(f"{where}/m.csv")
    return one.join(v.spark.read.parquet(f"{where}/m.parquet").withColumnRenamed("x", "y"), ["security_id", "as_of_date"])


def prediction_files(v: Views) -> DataFrame:
    panel = v.securities().select("security_id", "symbol", F.lit(dt.date(2000, 1, 1)).alias("as_of_date"), F.col("security_id").cast("double").alias("p"))
    run = runs.forecast_id("m", dt.date(2000, 1, 1), panel, "ebit")
    where = sinks.write_predictions(runs.forecast_rows(panel, "p", "ebit", "m", run), folders.passing_folder(v.spark, "predictions"), run)
    return v.spark.read.parquet(where).select("security_id", "symbol", "as_of_date", "metric", "prediction", "model_name", F.length("run_id").alias("id_length"))


def cache_entries(v: Views) -> DataFrame:
    """Each order twice in a cache, the second time with another price and for some without: the last entry counts, a kept null is a hit."""
    cache = runs.Cache(v.spark, f"{folders.passing_folder(v.spark, 'cache')}/c")
    orders = v.table("orders")
    key = F.sha2(F.col("o_orderkey").cast("string"), 256).alias("cache_key")
    cache.put(orders.select(key, F.col("o_totalprice").cast("double").alias("prediction")))
    cache.put(orders.where("o_orderkey % 3 <> 0").select(key, F.when(F.col("o_orderkey") % 3 == 1, F.col("o_totalprice").cast("double") + 1).alias("prediction")))
    met = cache.look_up(orders.select("o_orderkey", key).union(v.spark.createDataFrame([(-1, "none")], "o_orderkey long, cache_key string")))
    return met.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "hit", F.round("prediction", 2).alias("prediction"))


def run_records(v: Views) -> DataFrame:
    """A run a security, each recorded twice: once is kept."""
    registry = runs.Runs(v.spark, f"{folders.passing_folder(v.spark, 'runs')}/r")
    names = [r.symbol for r in v.securities().where("cast(security_id as int) < 4").orderBy("symbol").collect()]
    for name in names * 2:
        registry.record(run_id=f"run-{name}", mode="adhoc", config_flags_hash=runs.config_hash({"k": name}), metric="ebit", status="ok", started_at="2024-01-01T10:00", config={"k": name})
    return registry.list("adhoc", "ebit").select("run_id", "mode", "metric", "status", F.expr("config['k']").alias("k"))


QUERIES = {
    "src3_company_facts": company_files,
    "src5_quote_files": quote_files,
    "src7_estimate_files": estimate_files,
    "src9_ticker_files": ticker_files,
    "snk1_append": appended,
    "snk2_new_securities": new_securities,
    "snk3_partial_update": replaced,
    "snk5_matrix_files": matrix_files,
    "snk7_prediction_files": prediction_files,
    "snk8_run_records": run_records,
    "snk9_cache_entries": cache_entries,
    "flt14_symbols": lambda v: files.of_symbols(v.securities(), SYMBOLS),
}
_ID = "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))"
SQL = {
    "src3_company_facts": sql(f"SELECT lpad(security_id, 10, '0') AS cik, 'Revenues' AS concept, 'USD' AS unit, end_date AS \"end\", filing_date AS filed, fiscal_year AS fy, period AS fp, revenue AS value FROM inc0 WHERE revenue IS NOT NULL AND filing_date >= DATE '{SINCE}'", "inc0"),
    "src5_quote_files": sql("SELECT 'all' AS security_id, date, open, high, low, close, adj_close, volume FROM px WHERE date BETWEEN DATE '1996-03-01' AND DATE '2000-12-31'", "px"),
    "src7_estimate_files": sql("SELECT period, avg, numberOfAnalysts FROM est0", "est0"),
    "src9_ticker_files": sql("SELECT symbol, cik FROM sec", "sec"),
    "snk1_append": sql("SELECT security_id, fiscal_year, period, end_date, accepted_date, revenue, net_income, true AS no_ebit FROM inc0", "inc0"),
    "snk2_new_securities": sql(f"SELECT CASE WHEN CAST(security_id AS INT) < 10 THEN security_id ELSE {_ID} END AS security_id, symbol, cik FROM (SELECT *, sha256(cik) AS h FROM sec)", "sec"),
    "snk3_partial_update": sql("SELECT security_id, symbol, cik, CASE WHEN sector <> '  ' THEN sector END AS sector, industry, country, 'OLD' AS exchange FROM sec", "sec"),
    "snk5_matrix_files": sql("SELECT DISTINCT security_id, as_of_date, (as_of_date - DATE '1990-01-01') / 8e0 AS x, (as_of_date - DATE '1990-01-01') / 8e0 AS y FROM grid", "grid"),
    "snk7_prediction_files": sql("SELECT security_id, symbol, DATE '2000-01-01' AS as_of_date, 'ebit' AS metric, CAST(security_id AS DOUBLE) AS prediction, 'm' AS model_name, 36 AS id_length FROM sec", "sec"),
    "snk8_run_records": sql("SELECT 'run-' || symbol AS run_id, 'adhoc' AS mode, 'ebit' AS metric, 'ok' AS status, '\"' || symbol || '\"' AS k FROM sec WHERE CAST(security_id AS INT) < 4", "sec"),
    "snk9_cache_entries": "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, true AS hit, round(CASE o_orderkey % 3 WHEN 0 THEN CAST(o_totalprice AS DOUBLE) WHEN 1 THEN CAST(o_totalprice AS DOUBLE) + 1 END, 2) AS prediction FROM orders UNION ALL SELECT -1, false, NULL",
    "flt14_symbols": sql(f"SELECT * FROM sec WHERE symbol IN ({', '.join(repr(s) for s in SYMBOLS)})", "sec"),
}
