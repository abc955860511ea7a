"""From facts to statements."""

import pytest
from pyspark.sql import functions as F
from pytest_help import D, securities, versions
from tidemark.operators import market, normalize

SCHEMA = "security_id string, concept string, start date, end date, filed date, fy int, fp string, form string, value double, unit string"


def fact(concept, start, end, filed, fp, form, value, unit="USD", fy=2023):
    return ("s", concept, start and D(start), D(end), D(filed), fy, fp, form, float(value), unit)


def year(end_year, value, filed, concept="Revenues"):
    return fact(concept, f"{end_year}-01-01", f"{end_year}-12-31", filed, "FY", "10-K", value)


QUARTERS = [fact("Revenues", "2023-01-01", "2023-03-31", "2023-05-01", "Q1", "10-Q", 80), fact("Revenues", "2023-04-01", "2023-06-30", "2023-08-01", "Q2", "10-Q", 100), fact("Revenues", "2023-07-01", "2023-09-30", "2023-11-01", "Q3", "10-Q", 110)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, rows, name="income_statement"):
    return {(r.fiscal_year, r.period, r.accepted_date.isoformat()): r for r in normalize.normalise(frame(spark, rows))[name].collect()}


def test_the_fourth_quarter_is_the_year_less_three_quarters(spark):
    got = table(spark, [*QUARTERS, year(2023, 400, "2024-02-01")])
    q4 = got[2023, "Q4", "2024-02-01"]
    assert q4.revenue == 110 and q4.end_date == D("2023-12-31") and got[2023, "Q1", "2023-05-01"].revenue == 80


def test_a_restated_quarter_counts_only_from_its_day_on(spark):
    again = fact("Revenues", "2023-01-01", "2023-03-31", "2024-08-15", "Q1", "10-Q/A", 82)
    got = table(spark, [*QUARTERS, again, year(2023, 400, "2024-02-01"), fact("Revenues", "2023-01-01", "2023-12-31", "2024-08-15", "FY", "10-K/A", 405)])
    assert got[2023, "Q4", "2024-02-01"].revenue == 110 and got[2023, "Q4", "2024-08-15"].revenue == 405 - 82 - 100 - 110


def test_without_three_quarters_there_is_no_fourth(spark):
    assert (2023, "Q4", "2024-02-01") not in table(spark, [*QUARTERS[:2], year(2023, 400, "2024-02-01")])


def test_per_share_values_have_no_fourth_quarter(spark):
    eps = [("s", "EarningsPerShareDiluted", r[2], r[3], r[4], r[5], r[6], r[7], 1.0, "USD/shares") for r in [*QUARTERS, year(2023, 4, "2024-02-01")]]
    got = table(spark, [*QUARTERS, year(2023, 400, "2024-02-01"), *eps])
    assert got[2023, "Q4", "2024-02-01"].eps_diluted is None and got[2023, "FY", "2024-02-01"].eps_diluted == 1


def test_year_to_date_twins_are_dropped(spark):
    twin = fact("Revenues", "2023-01-01", "2023-06-30", "2023-08-01", "Q2", "10-Q", 180)
    assert table(spark, [*QUARTERS, twin, year(2023, 400, "2024-02-01")])[2023, "Q2", "2023-08-01"].revenue == 100


def test_the_first_concept_of_the_list_wins_and_units_must_fit(spark):
    rows = [year(2023, 400, "2024-02-01"), year(2023, 390, "2024-02-01", "SalesRevenueNet"), fact("GrossProfit", "2023-01-01", "2023-12-31", "2024-02-01", "FY", "10-K", 5, "EUR")]
    got = table(spark, rows)[2023, "FY", "2024-02-01"]
    assert got.revenue == 400 and got.gross_profit is None


def test_instants_belong_to_the_nearest_period_end(spark):
    rows = [year(2023, 400, "2024-02-01"), fact("Assets", None, "2023-12-31", "2024-05-01", "Q1", "10-Q", 7), fact("Assets", None, "2023-10-05", "2023-11-01", "Q3", "10-Q", 6), fact("Assets", None, "2023-11-15", "2023-12-01", "Q3", "10-Q", 5)]
    got = table(spark, rows, "balance_sheet")
    assert {k[:2]: r.total_assets for k, r in got.items()} == {(2023, "FY"): 7.0, (2023, "Q3"): 6.0}


def test_the_calendar_falls_back_on_third_quarters(spark):
    got = normalize.fiscal_calendar(frame(spark, QUARTERS)).collect()
    assert [(r.year, r.year_end) for r in got] == [(2023, D("2023-12-30"))]  # 91 days on
    assert normalize.fiscal_calendar(frame(spark, QUARTERS[:2])).collect() == []


def test_fiscal_year_of_a_filer_whose_year_ends_in_september(spark):
    cal = spark.createDataFrame([("s", 2022, D("2022-09-24")), ("s", 2023, D("2023-09-30"))], "security_id string, year int, year_end date")
    ends = spark.createDataFrame([("s", D(d)) for d in ("2022-09-24", "2022-12-31", "2023-09-30", "2023-12-30")], "security_id string, end date")
    assert {str(r.end): r.fiscal_year for r in normalize.with_fiscal_year(ends, cal).collect()} == {"2022-09-24": 2022, "2022-12-31": 2023, "2023-09-30": 2023, "2023-12-30": 2023}


def test_statements_are_planned_from_kept_versions(spark):
    """Each table's plan reads its versions a few times, whatever its facts come from."""
    got = normalize.normalise(frame(spark, [*QUARTERS, year(2023, 400, "2024-02-01")]))
    leaves = {name: t._jdf.queryExecution().optimizedPlan().collectLeaves().size() for name, t in got.items()}
    assert max(leaves.values()) <= 4, leaves


def test_concept_sources(spark):
    got = normalize.concept_sources(frame(spark, [year(2023, 390, "2024-02-01", "SalesRevenueNet")]), "revenue", 2023, "FY").collect()
    assert [(r.concept, r.priority, r.value) for r in got] == [("SalesRevenueNet", 2, 390.0)]


def test_anchor_check(spark):
    inc = versions(spark, ["revenue", "net_income", "eps_diluted"], [(2023, "FY", "2023-12-31", "2024-02-01", 1000, 0.001, 2.0)])
    truth = spark.createDataFrame([("0000000001", 2023, "revenue", 1004.0), ("0000000001", 2023, "net_income", 0.0), ("0000000001", 2023, "eps_diluted", 2.1), ("0000000009", 2023, "revenue", 1.0)], "cik string, fiscal_year int, field string, expected double")
    got = {(r.cik[-1], r.field): r.ok for r in normalize.anchor_check(inc, securities(spark), truth).collect()}
    assert got == {("1", "revenue"): True, ("1", "net_income"): True, ("1", "eps_diluted"): False, ("9", "revenue"): False}


def test_unsplit_quotes(spark):
    px = spark.createDataFrame([("s", D("2020-08-28"), 10.0, 10.0, 10.0, 10.0, 9.0, 800), ("s", D("2020-08-31"), 20.0, 20.0, 20.0, 20.0, 9.0, 100)], "security_id string, date date, open double, high double, low double, close double, adj_close double, volume long")
    splits = spark.createDataFrame([("s", D("2020-08-31"), 4.0)], "security_id string, date date, ratio double")
    got = {str(r.date): (r.close, r.adj_close, r.volume) for r in market.unsplit(px, splits).collect()}
    assert got == {"2020-08-28": (40.0, 9.0, 200), "2020-08-31": (20.0, 9.0, 100)}


@pytest.mark.parametrize(("label", "day", "target"), [("0q", "2024-05-15", "2024-06-30"), ("+1q", "2024-05-15", "2024-09-30"), ("0y", "2024-05-15", "2024-12-31"), ("+1Y", "2024-05-15", "2025-12-31"), ("+1q", "2024-11-15", "2025-03-31"), ("x", "2024-05-15", None)])
def test_estimate_labels(spark, label, day, target):
    got = spark.range(1).select(market.label_date(F.lit(label), F.lit(day).cast("date")).alias("d")).first().d
    assert got == (target and D(target))


def test_securities_are_made_once_and_filled_in(spark):
    have = spark.createDataFrame([("x", "A", "1", "Old", None, "US", None)], "security_id string, symbol string, cik string, sector string, industry string, country string, exchange string")
    more = market.with_new_securities(have, spark.createDataFrame([("A", "1"), ("B", "2")], "symbol string, cik string"))
    again = market.with_new_securities(more, spark.createDataFrame([("B", "2")], "symbol string, cik string"))
    assert sorted(map(str, more.collect())) == sorted(map(str, again.collect())) and more.count() == 2
    filled = market.with_metadata(more, spark.createDataFrame([("1", "New", "", None, "N")], "cik string, sector string, industry string, country string, exchange string"))
    assert {r.cik: (r.sector, r.industry, r.country, r.exchange) for r in filled.collect()}["1"] == ("New", None, "US", "N")
