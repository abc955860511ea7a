"""Point-in-time access and grids, on hand-made restatements."""

import datetime as dt
import random

import pytest
from pytest_help import D, grid, securities, versions
from tidemark import schema
from tidemark.operators import grids, pit

FIELDS = ["revenue", "net_income", "eps_diluted", "ebit", "ebitda", "gross_profit"]


def income(spark, rows):
    return versions(spark, FIELDS, [(*r, *[None] * (len(FIELDS) + 4 - len(r))) for r in rows])


RESTATED = [(2020, "FY", "2020-09-30", "2020-11-01", 100e9, 20e9, 1.50), (2020, "FY", "2020-09-30", "2023-11-01", None, None, 1.55)]
TRAP = [(2023, "FY", "2023-09-30", "2023-11-03", 1, 1, 6.13), (2023, "FY", "2023-09-30", "2024-11-01", 1, 1, 6.13), (2024, "FY", "2024-09-30", "2024-11-01", 1, 1, 6.72)]


@pytest.mark.parametrize("build", [pit.series, pit.series_dense])
def test_a_partial_restatement_keeps_what_it_does_not_repeat(spark, build):
    got = {r.as_of_date: r for r in build(grid(spark, "2024-01-01", "2022-01-01", "2020-10-31"), income(spark, RESTATED)).collect()}
    late, early = got[D("2024-01-01")], got[D("2022-01-01")]
    assert (late.revenue, late.net_income, late.eps_diluted, late.accepted_date) == (100e9, 20e9, 1.55, D("2023-11-01"))
    assert (early.eps_diluted, early.accepted_date) == (1.50, D("2020-11-01"))
    assert D("2020-10-31") not in got


def test_a_row_is_visible_on_its_day_and_not_the_day_before(spark):
    got = pit.series(grid(spark, "2020-11-01", "2020-10-31"), income(spark, RESTATED))
    assert [r.as_of_date for r in got.collect()] == [D("2020-11-01")]


def test_later_rows_change_nothing_known_before(spark):
    rng = random.Random(3)
    day = lambda: f"{rng.randrange(2015, 2022)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 28):02}"
    rows = {(y, p, day()): (y, p, f"{y}-12-31", None) for y in range(2015, 2019) for p in ("FY", "Q1") for _ in range(6)}
    rows = [(y, p, end, acc, *[rng.choice([None, rng.random()]) for _ in range(3)]) for (y, p, acc), (_, _, end, _) in rows.items()]
    points = ["2017-06-30", "2019-01-01"]
    every, past = income(spark, rows), income(spark, [r for r in rows if r[3] <= "2019-01-01"])
    keep = sorted(map(str, pit.series(grid(spark, *points), every).collect()))
    assert keep == sorted(map(str, pit.series(grid(spark, *points), past).collect()))
    assert keep == sorted(map(str, pit.series_dense(grid(spark, *points), every).select(pit.series(grid(spark, *points), every).columns).collect()))


def test_latest_row_takes_the_row_as_it_is(spark):
    got = pit.latest_row(grid(spark, "2024-01-01"), income(spark, RESTATED), ["revenue", "eps_diluted"]).collect()
    assert [(r.revenue, r.eps_diluted) for r in got] == [(None, 1.55)]
    with pytest.raises(ValueError):
        pit.latest_row(grid(spark, "2024-01-01"), income(spark, RESTATED), [])


def test_the_target_is_the_first_year_first_disclosed_after_the_date(spark):
    table = income(spark, TRAP)
    got = pit.next_target(grid(spark, "2024-05-15", "2023-11-03", "2023-11-02", "2024-11-01"), table, "eps_diluted").collect()
    found = {r.as_of_date: (r.target_fy, r.target_accepted_date, r.target_value) for r in got}
    assert found == {D("2024-05-15"): (2024, D("2024-11-01"), 6.72), D("2023-11-03"): (2024, D("2024-11-01"), 6.72), D("2023-11-02"): (2023, D("2023-11-03"), 6.13)}
    with pytest.raises(ValueError):
        pit.next_target(grid(spark, "2024-05-15"), table, "revenue")


def test_last_actual_and_latency(spark):
    got = pit.last_actual(grid(spark, "2024-05-15", "2023-01-01"), income(spark, TRAP), "eps_diluted").collect()
    assert [(r.as_of_date, r.naive_baseline) for r in got] == [(D("2024-05-15"), 6.13)]
    assert {r.fiscal_year: r.latency_days for r in pit.filing_latency(income(spark, TRAP), "eps_diluted").collect()} == {2023: 34, 2024: 32}


def test_consensus_sees_whole_seconds_of_the_day(spark):
    pulls = [dt.datetime(2024, 5, 1, 23, 59, 59), dt.datetime(2024, 5, 1, 23, 59, 59, 1), dt.datetime(2024, 5, 2)]
    rows = spark.createDataFrame([("s", D("2024-06-30"), p, "eps", float(i), 1) for i, p in enumerate(pulls)], schema.TABLES["analyst_estimates"])
    assert [r.consensus for r in pit.consensus(grid(spark, "2024-05-01"), rows).collect()] == [0.0]


def test_consensus_pick_takes_the_latest_pull_of_the_nearest_target(spark):
    rows = [("s", D("2024-06-30"), dt.datetime(2024, 4, 1), "eps", 1.0, 1), ("s", D("2024-06-30"), dt.datetime(2024, 4, 9), "eps", 2.0, 1), ("s", D("2024-12-31"), dt.datetime(2024, 4, 9), "eps", 3.0, 1), ("s", D("2024-03-31"), dt.datetime(2024, 4, 9), "eps", 4.0, 1)]
    table = spark.createDataFrame(rows, schema.TABLES["analyst_estimates"])
    assert [r.consensus for r in pit.consensus_pick(grid(spark, "2024-05-01"), table, "eps_diluted").collect()] == [2.0]
    assert pit.consensus_pick(grid(spark, "2024-05-01"), table, "eps_diluted", farthest=True).collect() == []


def test_blank_sectors_are_null(spark):
    assert [r.sector for r in pit.sectors(grid(spark, "2024-01-01"), securities(spark, sector="  ")).collect()] == [None]


def test_grids(spark):
    table, who = income(spark, TRAP), securities(spark)
    assert sorted((r.as_of_date.isoformat(), r.as_of_source) for r in grids.filing_dates(table, who).collect()) == [("2023-11-03", "income_statement.FY.2023"), ("2024-11-01", "income_statement.FY.2023"), ("2024-11-01", "income_statement.FY.2024")]
    assert sorted(r.as_of_date.isoformat() for r in grids.fiscal_year_end(table, who).collect()) == ["2023-11-03", "2024-11-01"]
    assert sorted(r.as_of_date.isoformat() for r in grids.audit(table, who).collect()) == ["2024-11-01", "2024-11-01"]
    days = sorted(r.as_of_source for r in grids.daily(who, D("2020-01-01"), D("2020-01-10")).collect())
    assert len(days) == 10 and days[5] == "calendar.2020-01-06"


def test_folds(spark):
    rows = grids.folds(spark, 2020, 2021).orderBy("fold_idx").collect()
    assert [r.cutoff.isoformat() for r in rows] == ["2020-05-15", "2020-08-14", "2020-11-15", "2021-03-01", "2021-05-15", "2021-08-14", "2021-11-15", "2022-03-01"]
    assert rows[0].is_seed and not rows[1].is_seed and rows[-1].window_end == D("2023-01-01") and rows[0].window_end == rows[1].cutoff


@pytest.mark.parametrize("name", ["", "1a", "a b", 'a"; drop table x; --', "a" * 64, None, "a.b"])
def test_names_that_are_not_identifiers_are_refused(name):
    with pytest.raises(ValueError):
        schema.check_name(name)


def test_unknown_tables_are_refused():
    assert schema.check_table("prices") == "prices"
    for bad in ("other", "securities"):
        with pytest.raises(ValueError):
            schema.check_statement(bad)
