"""Queries for features, the feature matrix and coverage audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import coverage, features, pit
from tidemark.plans.pit_queries import _state, year_grid
from tidemark.plans.views import BALANCE, CASH, INCOME, Views, sql
from tidemark.schema import FIELDS

GROUPS = {
    "feat_01_15_latest": (["revenue_latest", "net_income_latest", "ebit_latest", "gross_profit_latest", "eps_diluted_latest", "total_assets_latest", "total_equity_latest", "cash_and_equivalents_latest", "current_assets_latest", "current_liabilities_latest", "long_term_debt_latest", "operating_cf_latest", "investing_cf_latest", "financing_cf_latest", "capex_latest"], 2),
    "feat_16_23_prices": (["close_latest", "return_1m", "return_3m", "return_6m", "return_12m", "volatility_30d", "volatility_90d", "max_drawdown_1y"], 6),
    "feat_24_34_sectors": (list(features.SECTORS), 0),
    "feat_35_38_ttm": (["revenue_ttm", "net_income_ttm", "ebit_ttm", "gross_profit_ttm"], 2),
    "feat_39_42_growth": (["revenue_yoy", "net_income_yoy", "ebit_yoy", "eps_yoy"], 8),
    "feat_43_45_margins": (["gross_margin", "ebit_margin", "net_margin"], 8),
    "feat_46_51_balance": (["total_liabilities_latest", "equity_to_assets", "liabilities_to_assets", "current_ratio", "debt_to_equity", "debt_to_assets"], 6),
    "feat_52_55_cash": (["fcf_latest", "operating_cf_ttm", "capex_ttm", "fcf_ttm"], 2),
    "feat_56_59_returns": (["return_on_assets", "return_on_equity", "return_on_invested_capital", "pe_ratio_ttm"], 8),
    "feat_60_64_composites": (list(features.EARNINGS_QUALITY), 6),
}


def _rounded(frame: DataFrame) -> DataFrame:
    digits = {n: d for names, d in GROUPS.values() for n in names}
    return frame.select(*pit.GRID, *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in frame.columns if c not in pit.GRID])


def group(name: str):
    names = GROUPS[name][0]
    return lambda v: _rounded(features.matrix(year_grid(v).select(*pit.GRID).distinct(), v.tables(), features.BUILTIN.select(names)))


def full_matrix(v: Views) -> DataFrame:
    return _rounded(features.matrix(year_grid(v).select(*pit.GRID).distinct(), v.tables()))


AT = dt.date(1999, 6, 30)
PANEL = ["revenue_ttm", "gross_margin", "net_margin", "return_on_equity"]

QUERIES = {name: group(name) for name in GROUPS} | {
    "mtx1_feature_matrix": full_matrix,
    "mtx2_inference_panel": lambda v: _rounded(features.inference_panel(v.securities(), v.tables(), AT, PANEL)),
    "cov1_statement_coverage": lambda v: coverage.statement_coverage(v.income(), FIELDS["income_statement"]),
    "cov2_feature_coverage": lambda v: coverage.feature_coverage(features.matrix(year_grid(v), v.tables(), features.BUILTIN.select(PANEL)), features.BUILTIN.select(PANEL)),
}

_ORDER = "ROW(end_date, period, fiscal_year)"
_BY = "security_id, as_of_date"
_STATES = {"s_inc": _state("inc", INCOME), "s_bal": _state("bal", BALANCE), "s_cf": _state("cf", CASH), "points": "SELECT DISTINCT security_id, as_of_date FROM grid"}
_SECTOR = {k: v.lower() for k, v in features.SECTORS.items()}


def _latest(f: str) -> str:
    return f"arg_max({f}, {_ORDER}) FILTER ({f} IS NOT NULL)"


def _pair(a: str, b: str, op: str) -> str:
    both = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
    x, y = f"arg_max({a}, {_ORDER}) {both}", f"arg_max({b}, {_ORDER}) {both}"
    return f"{x} / nullif({y}, 0)" if op == "/" else f"{x} - {y}"


def _per(table: str, columns: dict[str, str]) -> str:
    return f"SELECT {_BY}, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {table} GROUP BY {_BY}"


def _ttm(table: str, f: str, name: str) -> str:
    return f"""SELECT {_BY}, coalesce(CASE WHEN as_of_date - fy.e <= 366 THEN fy.v END, CASE WHEN n = 4 AND hi - lo BETWEEN 200 AND 320 AND as_of_date - hi <= 366 THEN s END) AS {name} FROM points
 LEFT JOIN (SELECT {_BY}, arg_max(struct_pack(e := end_date, v := {f}), {_ORDER}) AS fy FROM {table} WHERE period = 'FY' GROUP BY {_BY}) USING ({_BY})
 LEFT JOIN (SELECT {_BY}, count(*) AS n, max(end_date) AS hi, min(end_date) AS lo, sum({f}) AS s FROM (SELECT * FROM {table} WHERE period LIKE 'Q%' AND {f} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_BY} ORDER BY end_date DESC, period DESC, fiscal_year DESC) <= 4) GROUP BY {_BY}) USING ({_BY})"""


def _yoy(f: str, name: str, quarters: bool = False) -> str:
    years = f"SELECT {_BY}, count(*) AS ny, any_value({f}) FILTER (r = 1) AS y1, any_value({f}) FILTER (r = 2) AS y2 FROM (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY end_date DESC, period DESC, fiscal_year DESC) AS r FROM s_inc WHERE period = 'FY' AND {f} IS NOT NULL) GROUP BY {_BY}"
    qs = f"SELECT {_BY}, count(*) AS nq, sum({f}) FILTER (r <= 4) AS q1, sum({f}) FILTER (r BETWEEN 5 AND 8) AS q2, max(end_date) FILTER (r <= 4) - min(end_date) FILTER (r <= 4) AS d1, max(end_date) FILTER (r BETWEEN 5 AND 8) - min(end_date) FILTER (r BETWEEN 5 AND 8) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY end_date DESC, period DESC, fiscal_year DESC) AS r FROM s_inc WHERE period LIKE 'Q%' AND {f} IS NOT NULL) GROUP BY {_BY}"
    more = " WHEN nq >= 8 AND d1 BETWEEN 200 AND 320 AND d2 BETWEEN 200 AND 320 THEN (q1 - q2) / nullif(q2, 0)" if quarters else ""
    return f"SELECT {_BY}, CASE WHEN ny >= 2 THEN (y1 - y2) / nullif(y2, 0){more} END AS {name} FROM points LEFT JOIN ({years}) USING ({_BY}) LEFT JOIN ({qs}) USING ({_BY})"


def _years(table: str, fields: list[str], prefix: str) -> str:
    cols = ", ".join(f"any_value({f}) FILTER (r = {k}) AS {prefix}{f}_{k}" for f in fields for k in (1, 2))
    return f"SELECT {_BY}, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY end_date DESC, period DESC, fiscal_year DESC) AS r FROM {table} WHERE period = 'FY') GROUP BY {_BY}"


def _join(*parts: str) -> str:
    return "points " + " ".join(f"LEFT JOIN ({p}) USING ({_BY})" for p in parts)


_LIAB = "coalesce(tl, gap)"
_LATEST_BAL = {"tl": _latest("total_liabilities"), "gap": _pair("total_assets", "total_equity", "-"), "ta": _latest("total_assets"), "te": _latest("total_equity"), "ltd": _latest("long_term_debt"), "equity_to_assets": _pair("total_equity", "total_assets", "/"), "current_ratio": _pair("current_assets", "current_liabilities", "/"), "debt_to_equity": _pair("long_term_debt", "total_equity", "/"), "debt_to_assets": _pair("long_term_debt", "total_assets", "/")}
_PX = "SELECT security_id, date, close, lag(close) OVER w AS was, row_number() OVER w AS n FROM px WHERE close IS NOT NULL WINDOW w AS (PARTITION BY security_id ORDER BY date)"
_MOVES = f"SELECT *, CASE WHEN was <> 0 THEN (close - was) / was END AS move, CASE WHEN was = 0 AND close <> 0 THEN 1 ELSE 0 END AS bad FROM ({_PX})"
_VOL = ", ".join(f"CASE WHEN n > {k} AND max(bad) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) = 0 THEN stddev_samp(move) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END AS volatility_{k}d" for k in (30, 90))
_RET = ", ".join(f"(arg_max(close, date) - arg_max(close, date) FILTER (date <= as_of_date - {d})) / nullif(arg_max(close, date) FILTER (date <= as_of_date - {d}), 0) AS {k}" for k, d in features.RETURN_DAYS.items())
_CLOSE = f"SELECT {_BY}, arg_max(close, date) AS close_latest, {_RET}, arg_max_null(volatility_30d, date) AS volatility_30d, arg_max_null(volatility_90d, date) AS volatility_90d FROM points JOIN (SELECT *, {_VOL} FROM ({_MOVES})) USING (security_id) WHERE date <= as_of_date GROUP BY {_BY}"
_DROP = f"SELECT {_BY}, min((close - top) / nullif(top, 0)) AS max_drawdown_1y FROM (SELECT {_BY}, close, max(close) OVER (PARTITION BY {_BY} ORDER BY date ROWS UNBOUNDED PRECEDING) AS top FROM points JOIN px USING (security_id) WHERE close IS NOT NULL AND date <= as_of_date AND date >= as_of_date - 365) GROUP BY {_BY}"
_COMP = {
    "piotroski_f_score": "CASE WHEN ni / nullif(ta, 0) IS NOT NULL AND cfo IS NOT NULL AND cr IS NOT NULL AND cr0 IS NOT NULL THEN CAST(ni / nullif(ta, 0) > 0 AS INT) + CAST(cfo > 0 AS INT) + CAST(cfo > ni AS INT) + CAST(cr > cr0 AS INT) END",
    "ccc_days": "CASE WHEN i_revenue_1 - i_gross_profit_1 > 0 AND i_revenue_1 > 0 THEN 365e0 * (b_inventory_1 / (i_revenue_1 - i_gross_profit_1) + b_receivables_1 / i_revenue_1 - b_payables_1 / (i_revenue_1 - i_gross_profit_1)) END",
    "dechow_accruals": "CASE WHEN (ta + ta0) / 2 > 0 THEN (ni - cfo) / ((ta + ta0) / 2) END",
    "beneish_m_score": "-4.84e0 + 0.92e0 * ((b_receivables_1 / nullif(i_revenue_1, 0)) / nullif(b_receivables_2 / nullif(i_revenue_2, 0), 0)) + 0.528e0 * ((i_gross_profit_2 / nullif(i_revenue_2, 0)) / nullif(i_gross_profit_1 / nullif(i_revenue_1, 0), 0)) + 0.404e0 * ((1 - (b_current_assets_1 + b_ppe_1) / nullif(ta, 0)) / nullif(1 - (b_current_assets_2 + b_ppe_2) / nullif(ta0, 0), 0)) + 0.892e0 * (i_revenue_1 / nullif(i_revenue_2, 0)) + 0.115e0 * ((c_depreciation_2 / nullif(c_depreciation_2 + b_ppe_2, 0)) / nullif(c_depreciation_1 / nullif(c_depreciation_1 + b_ppe_1, 0), 0)) - 0.172e0 * ((i_sga_1 / nullif(i_revenue_1, 0)) / nullif(i_sga_2 / nullif(i_revenue_2, 0), 0)) + 4.679e0 * ((ni - cfo) / nullif(ta, 0)) - 0.327e0 * (((b_long_term_debt_1 + b_current_liabilities_1) / nullif(ta, 0)) / nullif((b_long_term_debt_2 + b_current_liabilities_2) / nullif(ta0, 0), 0))",
    "mohanram_g_score": "CASE WHEN ni / nullif(ta, 0) IS NOT NULL AND ni0 / nullif(ta0, 0) IS NOT NULL AND cfo IS NOT NULL THEN CAST(ni / nullif(ta, 0) > 0 AS INT) + CAST(cfo / nullif(ta, 0) > 0 AS INT) + CAST(cfo > ni AS INT) + CAST(ni / nullif(ta, 0) > ni0 / nullif(ta0, 0) AS INT) END",
}
_COMP_FROM = f"(SELECT *, i_net_income_1 AS ni, i_net_income_2 AS ni0, b_total_assets_1 AS ta, b_total_assets_2 AS ta0, c_operating_cash_flow_1 AS cfo, b_current_assets_1 / nullif(b_current_liabilities_1, 0) AS cr, b_current_assets_2 / nullif(b_current_liabilities_2, 0) AS cr0 FROM {_join(_years('s_inc', ['net_income', 'revenue', 'gross_profit', 'sga'], 'i_'), _years('s_bal', ['total_assets', 'current_assets', 'current_liabilities', 'long_term_debt', 'receivables', 'ppe', 'inventory', 'payables'], 'b_'), _years('s_cf', ['operating_cash_flow', 'depreciation'], 'c_'))})"
_NAMES = {"operating_cf": "operating_cash_flow", "investing_cf": "investing_cash_flow", "financing_cf": "financing_cash_flow", "capex": "capital_expenditure"}


def _latest_of(names: list[str], fields: dict) -> dict[str, str]:
    return {n: _latest(_NAMES.get(n[:-7], n[:-7])) for n in names if _NAMES.get(n[:-7], n[:-7]) in fields}


_FROM = {
    "feat_01_15_latest": _join(*[_per(t, _latest_of(GROUPS["feat_01_15_latest"][0], f)) for t, f in (("s_inc", INCOME), ("s_bal", BALANCE), ("s_cf", CASH))]),
    "feat_16_23_prices": _join(_CLOSE, _DROP),
    "feat_24_34_sectors": f"(SELECT {_BY}, {', '.join(f"CASE WHEN nullif(trim(sector), '') IS NOT NULL THEN CAST(lower(sector) = '{v}' AS INT) END AS {k}" for k, v in _SECTOR.items())} FROM points LEFT JOIN sec USING (security_id))",
    "feat_35_38_ttm": _join(*[_ttm("s_inc", n[:-4], n) for n in GROUPS["feat_35_38_ttm"][0]]),
    "feat_39_42_growth": _join(_yoy("revenue", "revenue_yoy", True), _yoy("net_income", "net_income_yoy"), _yoy("ebit", "ebit_yoy"), _yoy("eps_diluted", "eps_yoy")),
    "feat_43_45_margins": _join(_per("s_inc", {"gross_margin": _pair("gross_profit", "revenue", "/"), "ebit_margin": _pair("ebit", "revenue", "/"), "net_margin": _pair("net_income", "revenue", "/")})),
    "feat_46_51_balance": f"(SELECT *, {_LIAB} AS total_liabilities_latest, {_LIAB} / nullif(ta, 0) AS liabilities_to_assets FROM {_join(_per('s_bal', _LATEST_BAL))})",
    "feat_52_55_cash": f"(SELECT *, operating_cf_ttm - capex_ttm AS fcf_ttm FROM {_join(_per('s_cf', {'fcf_latest': _pair('operating_cash_flow', 'capital_expenditure', '-')}), _ttm('s_cf', 'operating_cash_flow', 'operating_cf_ttm'), _ttm('s_cf', 'capital_expenditure', 'capex_ttm'))})",
    "feat_56_59_returns": f"(SELECT *, ni / nullif(ta, 0) AS return_on_assets, ni / nullif(te, 0) AS return_on_equity, ni / nullif(te + ltd, 0) AS return_on_invested_capital, close_latest / nullif(eps, 0) AS pe_ratio_ttm FROM {_join(_per('s_inc', {'ni': _latest('net_income')}), _per('s_bal', _LATEST_BAL), _ttm('s_inc', 'eps_diluted', 'eps'), _CLOSE)})",
    "feat_60_64_composites": f"(SELECT {_BY}, {', '.join(f'{v} AS {k}' for k, v in _COMP.items())} FROM {_COMP_FROM})",
}


def _body(name: str) -> str:
    names, digits = GROUPS[name]
    return f"SELECT {_BY}, {', '.join(f'CAST(round({n}, {digits}) AS DOUBLE) AS {n}' for n in names)} FROM {_FROM[name]}"


_ALL = ("inc", "bal", "cf", "grid", "px", "sec")
_DEDUP = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY security_id, fiscal_year, period ORDER BY end_date DESC, accepted_date DESC) AS rn FROM (SELECT security_id, fiscal_year, period, end_date, max(accepted_date) AS accepted_date, {aggs} FROM inc GROUP BY ALL)) WHERE rn = 1"
_IS = FIELDS["income_statement"]

SQL = {name: sql(_body(name), *_ALL, **_STATES) for name in GROUPS} | {
    "mtx1_feature_matrix": sql(f"SELECT * FROM points {' '.join(f'LEFT JOIN ({_body(n)}) USING ({_BY})' for n in GROUPS)}", *_ALL, **_STATES),
    "cov1_statement_coverage": sql(" UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS filled, count(*) AS total, count({f}) / CAST(count(*) AS DOUBLE) AS coverage FROM d" for f in _IS), "inc", d=_DEDUP.format(aggs=", ".join(f"arg_max({f}, accepted_date) AS {f}" for f in _IS))),
    "mtx2_inference_panel": sql(f"SELECT security_id, as_of_date, symbol, revenue_ttm, gross_margin, net_margin, return_on_equity FROM ({_body('feat_35_38_ttm')}) JOIN ({_body('feat_43_45_margins')}) USING ({_BY}) JOIN ({_body('feat_56_59_returns')}) USING ({_BY}) JOIN sec USING (security_id)", "inc", "bal", "cf", "px", "sec", grid=f"SELECT security_id, DATE '{AT}' AS as_of_date FROM sec", **_STATES),
    "cov2_feature_coverage": sql(" UNION ALL ".join(f"SELECT '{n}' AS feature, count({n}) AS filled, count(*) AS total, count({n}) / CAST(count(*) AS DOUBLE) AS coverage, {features.BUILTIN[n].min_coverage}e0 AS floor, count({n}) / CAST(count(*) AS DOUBLE) < {features.BUILTIN[n].min_coverage} AS below FROM m" for n in PANEL), *_ALL, **_STATES, m=f"SELECT revenue_ttm, gross_margin, net_margin, return_on_equity FROM grid JOIN ({_body('feat_35_38_ttm')}) USING ({_BY}) JOIN ({_body('feat_43_45_margins')}) USING ({_BY}) JOIN ({_body('feat_56_59_returns')}) USING ({_BY})"),
}
