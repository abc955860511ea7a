"""Features on hand-made statements."""

import math

import pytest
from pytest_help import D, grid, securities, versions
from tidemark.operators import coverage, features

INC = ["revenue", "gross_profit", "ebit", "net_income", "eps_diluted", "sga"]
BAL = ["total_assets", "total_equity", "total_liabilities", "current_assets", "current_liabilities", "long_term_debt", "receivables", "ppe", "inventory", "payables"]
CF = ["operating_cash_flow", "capital_expenditure", "depreciation"]


def pad(rows, n):
    return [(*r, *[None] * (n + 4 - len(r))) for r in rows]


def value(spark, name, day="2024-01-01", inc=(), bal=(), cf=(), prices=(), sector=None):
    tables = {"income_statement": versions(spark, INC, pad(inc, len(INC))), "balance_sheet": versions(spark, BAL, pad(bal, len(BAL))), "cashflow": versions(spark, CF, pad(cf, len(CF))), "securities": securities(spark, sector=sector)}
    tables["prices"] = spark.createDataFrame([("s", D(d), None if c is None else float(c)) for d, c in prices], "security_id string, date date, close double")
    return features.matrix(grid(spark, day), tables, features.BUILTIN.select([name])).first()[name]


def quarter(end, revenue):
    return (int(end[:4]), "Q" + str((int(end[5:7]) + 2) // 3), end, end, revenue)


def test_there_are_64_features_and_8_experimental_ones():
    assert len(features.BUILTIN) == 64 and sum(features.BUILTIN[n].experimental for n in features.BUILTIN.names()) == 8
    with pytest.raises(ValueError):
        features.BUILTIN.select(["revenue_ttm", "nothing"])
    with pytest.raises(ValueError):
        features.Registry([features.BUILTIN["close_latest"]] * 2)


def test_quarters_that_are_not_consecutive_make_no_year(spark):
    rows = [quarter(e, v) for e, v in (("2022-03-31", 100), ("2022-06-30", 110), ("2022-09-30", 120), ("2023-09-30", 130))]
    assert value(spark, "revenue_ttm", inc=rows) is None
    rows = [quarter(e, v) for e, v in (("2022-12-31", 100), ("2023-03-31", 110), ("2023-06-30", 120), ("2023-09-30", 130))]
    assert value(spark, "revenue_ttm", inc=rows) == 460


def test_a_recent_full_year_comes_before_quarters_and_an_old_one_does_not_count(spark):
    old = [(2022, "FY", "2022-12-31", "2023-02-01", 400)]
    assert value(spark, "revenue_ttm", "2024-01-01", inc=old) == 400
    assert value(spark, "revenue_ttm", "2024-01-02", inc=old) is None
    later_empty = [*old, (2023, "FY", "2023-12-31", "2024-01-01", None, 3)]
    assert value(spark, "revenue_ttm", "2024-01-01", inc=later_empty) is None


def test_growth(spark):
    years = [(2021, "FY", "2021-12-31", "2022-02-01", 100), (2022, "FY", "2022-12-31", "2023-02-01", 150)]
    assert value(spark, "revenue_yoy", inc=years) == pytest.approx(0.5)
    assert value(spark, "revenue_yoy", inc=[(2021, "FY", "2021-12-31", "2022-02-01", 0), years[1]]) is None
    eight = [quarter(e, v) for e, v in zip(("2022-03-31", "2022-06-30", "2022-09-30", "2022-12-31", "2023-03-31", "2023-06-30", "2023-09-30", "2023-12-31"), [10] * 4 + [11] * 4, strict=True)]
    assert value(spark, "revenue_yoy", inc=eight) == pytest.approx(0.1)
    assert value(spark, "net_income_yoy", inc=eight) is None


def test_the_fourth_quarter_stands_before_the_year_it_ends(spark):
    rows = [(2023, "FY", "2023-12-31", "2024-01-01", 400), (2023, "Q4", "2023-12-31", "2024-01-01", 110)]
    assert value(spark, "revenue_latest", inc=rows) == 110


def test_liabilities_fall_back_on_assets_less_equity(spark):
    assert value(spark, "total_liabilities_latest", bal=[(2023, "Q3", "2023-09-30", "2023-10-20", 3405765000, 2110678000)]) == 1295087000


def test_ratios_take_one_row_and_never_divide_by_zero(spark):
    rows = [(2023, "Q2", "2023-06-30", "2023-07-20", 100, 40), (2023, "Q3", "2023-09-30", "2023-10-20", 120, None)]
    assert value(spark, "gross_margin", inc=rows) == pytest.approx(0.4)
    assert value(spark, "gross_margin", inc=[(2023, "Q2", "2023-06-30", "2023-07-20", 0, 40)]) is None


def test_price_features(spark):
    rows = [(f"2023-{m:02}-{d:02}", 100 + (m * 31 + d) % 7) for m in range(1, 13) for d in range(1, 28)]
    rows += [("2023-12-29", None)]
    by_day = dict(rows)
    assert value(spark, "close_latest", prices=rows) == by_day["2023-12-27"]
    then = max(d for d, c in rows if c is not None and d <= "2023-12-02")
    assert value(spark, "return_1m", prices=rows) == pytest.approx(by_day["2023-12-27"] / by_day[then] - 1)
    last = [c for _, c in sorted(rows) if c is not None][-31:]
    moves = [b / a - 1 for a, b in zip(last, last[1:], strict=False)]
    mean = sum(moves) / 30
    assert value(spark, "volatility_30d", prices=rows) == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in moves) / 29))
    assert value(spark, "volatility_30d", prices=rows[-31:-1]) is None
    assert value(spark, "max_drawdown_1y", prices=rows) == pytest.approx(100 / 106 - 1)
    assert value(spark, "volatility_30d", prices=[(f"2023-{m:02}-{d:02}", 0 if (m, d) == (12, 20) else 5) for m in (11, 12) for d in range(1, 28)]) is None


def test_sectors(spark):
    assert value(spark, "sector_healthcare", sector="HEALTHCARE") == 1.0 and value(spark, "sector_energy", sector="Healthcare") == 0.0 and value(spark, "sector_energy", sector=" ") is None


YEAR_INC = [(2022, "FY", "2022-12-31", "2023-02-01", 900, 400, None, 80, None, 90), (2023, "FY", "2023-12-31", "2024-01-01", 1000, 450, None, 100, None, 95)]
YEAR_BAL = [(2022, "FY", "2022-12-31", "2023-02-01", 950, 500, None, 300, 200, 100, 80, 300, 50, 40), (2023, "FY", "2023-12-31", "2024-01-01", 1000, 550, None, 400, 200, 90, 100, 320, 60, 45)]
YEAR_CF = [(2022, "FY", "2022-12-31", "2023-02-01", 90, 10, 30), (2023, "FY", "2023-12-31", "2024-01-01", 120, 12, 33)]


def test_composites(spark):
    args = {"inc": YEAR_INC, "bal": YEAR_BAL, "cf": YEAR_CF}
    assert value(spark, "piotroski_f_score", **args) == 4.0
    assert value(spark, "piotroski_f_score", inc=YEAR_INC, bal=YEAR_BAL[1:], cf=YEAR_CF) is None
    assert value(spark, "mohanram_g_score", **args) == 4.0
    assert value(spark, "dechow_accruals", **args) == pytest.approx((100 - 120) / 975)
    assert value(spark, "ccc_days", **args) == pytest.approx(365 * (60 / 550 + 100 / 1000 - 45 / 550))
    terms = [(100 / 1000) / (80 / 900), (400 / 900) / (450 / 1000), (1 - 720 / 1000) / (1 - 600 / 950), 1000 / 900, (30 / 330) / (33 / 353), (95 / 1000) / (90 / 900), (100 - 120) / 1000, (290 / 1000) / (300 / 950)]
    weights = [0.92, 0.528, 0.404, 0.892, 0.115, -0.172, 4.679, -0.327]
    assert value(spark, "beneish_m_score", **args) == pytest.approx(-4.84 + sum(w * t for w, t in zip(weights, terms, strict=True)))
    assert value(spark, "beneish_m_score", inc=[(*r[:4], 0, *r[5:]) for r in YEAR_INC], bal=YEAR_BAL, cf=YEAR_CF) is None


def test_missing_optional_columns_make_null(spark):
    tables = {"income_statement": versions(spark, ["revenue", "gross_profit"], [(2023, "FY", "2023-12-31", "2024-01-01", 10, 5)]), "balance_sheet": versions(spark, ["total_assets"], [(2023, "FY", "2023-12-31", "2024-01-01", 10)]), "cashflow": versions(spark, ["operating_cash_flow"], [])}
    got = features.matrix(grid(spark, "2024-01-01"), tables, features.BUILTIN.select(["ccc_days", "beneish_m_score", "net_margin"])).first()
    assert got.ccc_days is None and got.beneish_m_score is None and got.net_margin is None


def test_the_grid_keeps_repeated_points(spark):
    points = grid(spark, "2024-01-01", "2024-01-01")
    tables = {"income_statement": versions(spark, ["revenue"], [(2023, "Q1", "2023-03-31", "2023-05-01", 7)])}
    assert [r.revenue_latest for r in features.matrix(points, tables, features.BUILTIN.select(["revenue_latest"])).collect()] == [7.0, 7.0]


def test_feature_coverage(spark):
    registry = features.BUILTIN.select(["revenue_latest", "net_margin"])
    rows = spark.createDataFrame([(1.0, None), (2.0, 1.0)], "revenue_latest double, net_margin double")
    got = {r.feature: (r.filled, r.total, r.below) for r in coverage.feature_coverage(rows, registry).collect()}
    assert got == {"revenue_latest": (2, 2, False), "net_margin": (1, 2, True)}
