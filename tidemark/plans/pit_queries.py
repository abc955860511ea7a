"""Queries for grids, point-in-time access, normalisation and market data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import grids, market, normalize, pit
from tidemark.plans.views import BALANCE, CASH, INCOME, Views, sql

DAY1, DAY2 = dt.date(1999, 1, 1), dt.date(1999, 3, 31)
LITERAL = "1999-06-30"


def year_grid(v: Views) -> DataFrame:
    return grids.fiscal_year_end(v.income(), v.securities())


def _src(value: str) -> str:
    return f"concat('income_statement.', {value})"


def _grid_sql(body: str) -> str:
    return sql(f"SELECT security_id, symbol, as_of_date, as_of_source FROM ({body}) JOIN sec USING (security_id)", "inc", "sec")


def _state(table: str, fields: dict[str, str]) -> str:
    """Field-level state by the window form: last values carried on, the last version kept."""
    w = "OVER (PARTITION BY g.security_id, g.as_of_date, fiscal_year, period, end_date ORDER BY accepted_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cols = ", ".join(f"last_value({c} IGNORE NULLS) {w} AS {c}" for c in fields)
    return f"SELECT g.security_id, g.as_of_date, fiscal_year, period, end_date, accepted_date, filing_date, {cols} FROM grid g JOIN {table} t ON t.security_id = g.security_id AND t.accepted_date <= g.as_of_date QUALIFY row_number() OVER (PARTITION BY g.security_id, g.as_of_date, fiscal_year, period, end_date ORDER BY accepted_date DESC) = 1"


FIRST = "SELECT security_id, fiscal_year, accepted_date AS first_accepted, end_date, {m} AS value FROM inc WHERE period = 'FY' AND {m} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY security_id, fiscal_year ORDER BY accepted_date, end_date DESC) = 1"


def facts(v: Views) -> DataFrame:
    """Facts as a filer would disclose them, from reported versions: flows with their length, balances as instants."""
    flows = v.reported(INCOME | CASH).withColumn("start", F.expr("case when period = 'FY' then make_date(fiscal_year, 1, 1) else add_months(date_add(end_date, 1), -3) end"))
    names = {"revenue": "case when cast(security_id as int) % 2 = 0 then 'Revenues' else 'SalesRevenueNet' end", "gross_profit": "'GrossProfit'", "ebit": "'OperatingIncomeLoss'", "net_income": "case when cast(security_id as int) % 3 = 0 then 'ProfitLoss' else 'NetIncomeLoss' end", "eps_diluted": "'EarningsPerShareDiluted'", "operating_cash_flow": "'NetCashProvidedByUsedInOperatingActivities'", "capital_expenditure": "'PaymentsToAcquirePropertyPlantAndEquipment'"}
    points = {"total_assets": "'Assets'", "total_equity": "'StockholdersEquity'", "long_term_debt": "'LongTermDebtNoncurrent'"}

    def tall(rows: DataFrame, names: dict[str, str], start: str) -> DataFrame:
        stack = ", ".join(f"{c}, {f}, '{normalize.unit_of(f)}'" for f, c in names.items())
        form = "case when period = 'FY' then '10-K' else '10-Q' end"
        return rows.selectExpr("security_id", f"{start} as start", "end_date as end", "filing_date as filed", "fiscal_year as fy", "period as fp", f"{form} as form", f"stack({len(names)}, {stack}) as (concept, value, unit)").where("value is not null")

    return tall(flows, names, "start").unionByName(tall(v.reported(BALANCE), points, "cast(null as date)"))


QUERIES = {
    "grd1_filing_dates": lambda v: grids.filing_dates(v.income(), v.securities()),
    "grd2_fiscal_year_end": year_grid,
    "grd3_quarterly": lambda v: grids.quarterly(v.income(), v.securities()),
    "grd4_daily_calendar": lambda v: grids.daily(v.securities(), DAY1, DAY2),
    "grd5_audit_sample": lambda v: grids.audit(v.income(), v.securities()),
    "grd6_panel": lambda v: grids.panel(v.securities()),
    "grd7_folds": lambda v: grids.folds(v.spark, 1996, 2000),
    "pit1_latest_row": lambda v: pit.latest_row(year_grid(v), v.income(), ["fiscal_year", "period", "revenue", "ebit"]),
    "pit2_field_level_income": lambda v: pit.series(year_grid(v), v.income()),
    "pit3_field_level_balance": lambda v: pit.series(year_grid(v), v.balance()),
    "pit3_dense_daily": lambda v: pit.series_dense(grids.daily(v.securities(), DAY1, DAY2), v.income()).groupBy("as_of_date").agg(F.count("*").alias("n"), F.count("gross_profit").alias("n_gross_profit"), F.round(F.sum("revenue"), 1).alias("revenue")),
    "pit3_literal_date": lambda v: pit.series(v.securities().select("security_id", F.lit(LITERAL).cast("date").alias("as_of_date")), v.income()).select("security_id", "fiscal_year", "period", "end_date", "accepted_date", "net_income"),
    "pit4_consensus": lambda v: pit.consensus(v.securities().select("security_id", F.lit("2024-01-15").cast("date").alias("as_of_date")), estimates(v)),
    "pit4_consensus_pick": lambda v: pit.consensus_pick(v.securities().select("security_id", F.lit("2024-01-15").cast("date").alias("as_of_date")), estimates(v), "eps_diluted"),
    "pit5_prices": lambda v: pit.prices(year_grid(v), v.prices()).groupBy(*pit.GRID).agg(F.count("*").alias("n"), F.max("date").alias("last_date"), F.sum("volume").alias("volume")),
    "pit6_sectors": lambda v: pit.sectors(year_grid(v), v.securities()),
    "pit7_next_target": lambda v: pit.next_target(year_grid(v), v.income(), "eps_diluted"),
    "pit8_last_actual": lambda v: pit.last_actual(year_grid(v), v.income(), "ebit"),
    "pit10_annual_panel": lambda v: pit.annual_panel(v.income(), v.securities(), "revenue"),
    "pit11_filing_latency": lambda v: pit.filing_latency(v.income(), "gross_profit"),
    "nrm1_period_of": lambda v: facts(v).withColumn("period", normalize.period_of(F.col("form"), F.col("fp"))).groupBy("form", "fp", "period").agg(F.count("*").alias("n")),
    "nrm2_fiscal_calendar": lambda v: normalize.fiscal_calendar(facts(v)),
    "nrm3_fiscal_year": lambda v: normalize.with_fiscal_year(facts(v).select("security_id", "end").distinct(), normalize.fiscal_calendar(facts(v))),
    "nrm4_classify_instants": lambda v: normalize.classify_instants(facts(v).where("start is null").select("security_id", "end").distinct(), normalize.fiscal_calendar(facts(v))),
    "nrm6_income_statement": lambda v: normalize.statements(facts(v), "income_statement"),
    "nrm6_balance_sheet": lambda v: normalize.statements(facts(v), "balance_sheet"),
    "nrm7_fourth_quarters": lambda v: normalize.fourth_quarters(v.reported(INCOME)).select("security_id", "fiscal_year", "period", "end_date", "accepted_date", *[F.round(c, 2).alias(c) for c in ("revenue", "gross_profit", "ebit", "net_income", "eps_diluted")]),
    "nrm8_normalised_counts": lambda v: normalised_counts(v),
    "ts1_unsplit": lambda v: market.unsplit(v.prices(), splits(v)).select("security_id", "date", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume"),
    "cns1_label_dates": lambda v: v.raw_estimates().select("security_id", "pulled_at", "period", market.label_date(F.col("period"), F.col("pulled_at").cast("date")).alias("target_date")),
    "cns2_estimate_rows": lambda v: estimates(v),
    "flt9_right_length": lambda v: facts(v).withColumn("period", normalize.period_of(F.col("form"), F.col("fp"))).groupBy("period", normalize.right_length().alias("fits")).agg(F.count("*").alias("n")),
    "cov3_concept_sources": lambda v: normalize.concept_sources(facts(v), "revenue", 1999, "FY"),
    "jn1_anchor_join": lambda v: anchors(v),
}


def estimates(v: Views) -> DataFrame:
    raw = v.raw_estimates()
    parts = [market.estimate_rows(raw.where(F.col("metric") == m), m, F.col("security_id"), F.col("pulled_at")) for m in ("eps", "revenue")]
    return parts[0].unionByName(parts[1])


def splits(v: Views) -> DataFrame:
    """Two splits a security."""
    rows = v.securities().select("security_id", F.explode(F.array(F.struct(F.lit("1998-06-15").alias("d"), F.lit(2.0).alias("r")), F.struct(F.lit("2000-02-01").alias("d"), F.lit(1.5).alias("r")))).alias("s"))
    return rows.select("security_id", F.col("s.d").cast("date").alias("date"), F.col("s.r").alias("ratio"))


def normalised_counts(v: Views) -> DataFrame:
    out = None
    for name, table in normalize.normalise(facts(v)).items():
        part = table.groupBy("period").agg(F.count("*").alias("n")).select(F.lit(name).alias("statement"), "period", "n")
        out = part if out is None else out.unionByName(part)
    return out


def anchors(v: Views) -> DataFrame:
    """Every fifth year's revenue, partly wrong, held against the tables."""
    last = v.income().where("period = 'FY'").groupBy("security_id", "fiscal_year").agg(F.max_by("revenue", F.struct("accepted_date", "end_date")).alias("revenue"))
    truth = last.join(v.securities().select("security_id", "cik"), "security_id").where("fiscal_year % 5 = 1").select("cik", "fiscal_year", F.lit("revenue").alias("field"), F.expr("case when cast(security_id as int) % 4 = 0 then revenue * 1.01 else revenue * 1.001 end").alias("expected"))
    return normalize.anchor_check(v.income(), v.securities(), truth).select("cik", "fiscal_year", "field", F.round("expected", 2).alias("expected"), F.round("actual", 2).alias("actual"), "ok")


_EST = "SELECT security_id, CASE period WHEN '0q' THEN last_day(CAST(date_trunc('quarter', pulled_at) + INTERVAL 2 MONTH AS DATE)) WHEN '+1q' THEN last_day(CAST(date_trunc('quarter', pulled_at) + INTERVAL 5 MONTH AS DATE)) WHEN '0y' THEN make_date(year(pulled_at), 12, 31) WHEN '+1y' THEN make_date(year(pulled_at) + 1, 12, 31) END AS target_date, pulled_at, metric, avg AS consensus, CAST(nullif(numberOfAnalysts, 0) AS INT) AS n_analysts, period FROM est0"
_EST_OK = f"SELECT security_id, target_date, pulled_at, metric, consensus, n_analysts FROM ({_EST}) WHERE target_date IS NOT NULL AND consensus IS NOT NULL"
_AT = "(SELECT security_id, DATE '2024-01-15' AS as_of_date FROM sec)"
_CAL = "SELECT security_id, fiscal_year AS year, make_date(fiscal_year, 12, 31) AS year_end FROM (SELECT DISTINCT security_id, fiscal_year FROM inc0 WHERE period = 'FY' AND coalesce(revenue, gross_profit, ebit, net_income, eps_diluted) IS NOT NULL)"
_INC_FIELDS = ["revenue", "gross_profit", "ebitda", "ebit", "net_income", "eps_diluted"]
_BAL_FIELDS = ["total_assets", "total_liabilities", "total_equity", "cash_and_equivalents", "current_assets", "current_liabilities", "long_term_debt"]
_KNOWN_BAL = "coalesce(total_assets, total_equity, long_term_debt) IS NOT NULL"
_NULLS = "CAST(NULL AS DOUBLE)"
_N_FACTS = "SELECT period, CAST(sum(n) AS BIGINT) AS n FROM (SELECT period, count(revenue) + count(gross_profit) + count(ebit) + count(net_income) + count(eps_diluted) AS n FROM inc0 GROUP BY period UNION ALL SELECT period, count(operating_cash_flow) + count(capital_expenditure) FROM cf0 GROUP BY period UNION ALL SELECT period, count(total_assets) + count(total_equity) + count(long_term_debt) FROM bal GROUP BY period) GROUP BY period"
_COUNTS = " UNION ALL ".join(f"SELECT '{name}' AS statement, period, count(*) AS n FROM {view} WHERE {cond} GROUP BY period" for name, view, cond in (("income_statement", "inc", "coalesce(revenue, gross_profit, ebit, net_income, eps_diluted) IS NOT NULL"), ("balance_sheet", "bal", _KNOWN_BAL), ("cashflow", "cf", "coalesce(operating_cash_flow, capital_expenditure) IS NOT NULL")))

SQL = {
    "nrm1_period_of": sql(f"SELECT CASE WHEN period = 'FY' THEN '10-K' ELSE '10-Q' END AS form, period AS fp, period, n FROM ({_N_FACTS})", "inc0", "cf0", "bal"),
    "flt9_right_length": sql(f"SELECT period, TRUE AS fits, n FROM ({_N_FACTS})", "inc0", "cf0", "bal"),
    "cov3_concept_sources": sql("SELECT security_id, 'revenue' AS field, end_date AS \"end\", CASE WHEN CAST(security_id AS INT) % 2 = 0 THEN 'Revenues' ELSE 'SalesRevenueNet' END AS concept, CASE WHEN CAST(security_id AS INT) % 2 = 0 THEN 0 ELSE 2 END AS priority, revenue AS value FROM inc0 WHERE fiscal_year = 1999 AND period = 'FY' AND revenue IS NOT NULL QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY accepted_date DESC) = 1", "inc0"),
    "grd1_filing_dates": _grid_sql(f"SELECT DISTINCT security_id, accepted_date AS as_of_date, {_src("concat(period, '.', fiscal_year)")} AS as_of_source FROM inc"),
    "grd2_fiscal_year_end": _grid_sql(f"SELECT security_id, min(accepted_date) AS as_of_date, {_src("concat('FY.', fiscal_year)")} AS as_of_source FROM inc WHERE period = 'FY' GROUP BY security_id, fiscal_year"),
    "grd3_quarterly": _grid_sql(f"SELECT security_id, max(accepted_date) AS as_of_date, {_src("concat(period, '.', fiscal_year)")} AS as_of_source FROM inc GROUP BY security_id, fiscal_year, period"),
    "grd4_daily_calendar": sql(f"SELECT security_id, symbol, CAST(d AS DATE) AS as_of_date, concat('calendar.', strftime(d, '%Y-%m-%d')) AS as_of_source FROM sec, (SELECT unnest(generate_series(DATE '{DAY1}', DATE '{DAY2}', INTERVAL 1 DAY)) AS d)", "sec"),
    "grd5_audit_sample": _grid_sql(f"SELECT security_id, max(accepted_date) AS as_of_date, {_src("concat('FY.', fiscal_year)")} AS as_of_source FROM inc WHERE period = 'FY' GROUP BY security_id, fiscal_year"),
    "grd6_panel": sql("SELECT security_id, symbol, make_date(y, 5, 15) AS as_of_date, concat('panel.', y) AS as_of_source FROM sec, (SELECT unnest(range(2018, 2025)) AS y)", "sec"),
    "grd7_folds": "WITH c AS (SELECT make_date(y + k, m, d) AS cutoff FROM (SELECT unnest(range(1996, 2001)) AS y), (VALUES (0, 5, 15), (0, 8, 14), (0, 11, 15), (1, 3, 1)) AS x(k, m, d)) SELECT CAST(row_number() OVER (ORDER BY cutoff) - 1 AS INT) AS fold_idx, cutoff, coalesce(lead(cutoff) OVER (ORDER BY cutoff), DATE '2002-01-01') AS window_end, CAST(cutoff AS VARCHAR) AS cutoff_label, row_number() OVER (ORDER BY cutoff) = 1 AS is_seed FROM c",
    "pit1_latest_row": sql("SELECT DISTINCT ON (g.security_id, g.as_of_date) g.security_id, g.as_of_date, fiscal_year, period, revenue, ebit FROM grid g JOIN inc t ON t.security_id = g.security_id AND t.accepted_date <= g.as_of_date ORDER BY g.security_id, g.as_of_date, accepted_date DESC, end_date DESC, filing_date DESC, fiscal_year DESC, period DESC, revenue DESC", "inc", "grid"),
    "pit2_field_level_income": sql(_state("inc", INCOME), "inc", "grid"),
    "pit3_field_level_balance": sql(_state("bal", BALANCE), "inc", "bal", "grid"),
    "pit3_dense_daily": sql(f"SELECT as_of_date, count(*) AS n, count(gross_profit) AS n_gross_profit, round(sum(revenue), 1) AS revenue FROM ({_state('inc', INCOME).replace('grid g', 'days g')}) GROUP BY as_of_date", "inc", "sec", days=f"SELECT security_id, CAST(d AS DATE) AS as_of_date FROM sec, (SELECT unnest(generate_series(DATE '{DAY1}', DATE '{DAY2}', INTERVAL 1 DAY)) AS d)"),
    "pit3_literal_date": sql(f"SELECT security_id, fiscal_year, period, end_date, max(accepted_date) AS accepted_date, arg_max(net_income, accepted_date) AS net_income FROM inc WHERE accepted_date <= DATE '{LITERAL}' GROUP BY security_id, fiscal_year, period, end_date", "inc"),
    "pit4_consensus": sql(f"SELECT g.security_id, g.as_of_date, target_date, pulled_at, metric, consensus, n_analysts FROM {_AT} g JOIN e ON e.security_id = g.security_id AND pulled_at <= as_of_date + INTERVAL '23:59:59'", "sec", "est0", e=_EST_OK),
    "pit4_consensus_pick": sql(f"SELECT g.security_id, g.as_of_date, consensus FROM {_AT} g JOIN e ON e.security_id = g.security_id AND pulled_at <= as_of_date + INTERVAL '23:59:59' WHERE metric = 'eps' AND target_date >= as_of_date QUALIFY row_number() OVER (PARTITION BY g.security_id, g.as_of_date ORDER BY target_date, pulled_at DESC) = 1", "sec", "est0", e=_EST_OK),
    "pit5_prices": sql("SELECT g.security_id, g.as_of_date, count(*) AS n, max(date) AS last_date, CAST(sum(volume) AS BIGINT) AS volume FROM (SELECT DISTINCT * FROM grid) g JOIN px p ON p.security_id = g.security_id AND p.date <= g.as_of_date GROUP BY ALL", "inc", "grid", "px"),
    "pit6_sectors": sql("SELECT DISTINCT security_id, as_of_date, nullif(trim(sector), '') AS sector FROM grid LEFT JOIN sec USING (security_id)", "inc", "grid", "sec"),
    "pit7_next_target": sql("SELECT g.security_id, g.as_of_date, f.fiscal_year AS target_fy, f.first_accepted AS target_accepted_date, f.value AS target_value FROM (SELECT DISTINCT * FROM grid) g JOIN f ON f.security_id = g.security_id AND f.first_accepted > g.as_of_date QUALIFY row_number() OVER (PARTITION BY g.security_id, g.as_of_date ORDER BY f.fiscal_year) = 1", "inc", "grid", f=FIRST.format(m="eps_diluted")),
    "pit8_last_actual": sql("SELECT g.security_id, g.as_of_date, ebit AS naive_baseline FROM (SELECT DISTINCT * FROM grid) g JOIN inc t ON t.security_id = g.security_id AND t.accepted_date <= g.as_of_date WHERE period = 'FY' AND ebit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g.security_id, g.as_of_date ORDER BY end_date DESC, accepted_date DESC) = 1", "inc", "grid"),
    "pit10_annual_panel": sql("SELECT symbol, fiscal_year, end_date, first_accepted, value FROM f JOIN sec USING (security_id)", "inc", "sec", f=FIRST.format(m="revenue")),
    "pit11_filing_latency": sql("SELECT security_id, fiscal_year, CAST(first_accepted - end_date AS BIGINT) AS latency_days FROM f", "inc", f=FIRST.format(m="gross_profit")),
    "nrm2_fiscal_calendar": sql(f"SELECT security_id, CAST(year AS INT) AS year, year_end FROM ({_CAL})", "inc0"),
    "nrm3_fiscal_year": sql(f"SELECT DISTINCT security_id, end_date AS \"end\", CAST(coalesce(CASE WHEN c.year_end >= end_date THEN c.year END, CASE WHEN n.year IS NOT NULL THEN n.year END, year(end_date)) AS INT) AS fiscal_year FROM (SELECT security_id, end_date FROM inc0 WHERE coalesce(revenue, gross_profit, ebit, net_income, eps_diluted) IS NOT NULL UNION SELECT security_id, end_date FROM bal WHERE {_KNOWN_BAL}) e LEFT JOIN c USING (security_id) LEFT JOIN c n USING (security_id) WHERE c.year = year(end_date) AND n.year = year(end_date) + 1 OR c.year = year(end_date) AND NOT EXISTS (SELECT 1 FROM c x WHERE x.security_id = e.security_id AND x.year = year(e.end_date) + 1) AND n.year = c.year", "inc0", "bal", c=_CAL),
    "nrm4_classify_instants": sql(f"SELECT security_id, end_date AS \"end\", CAST(fy AS INT) AS fiscal_year, p AS period FROM (SELECT DISTINCT security_id, end_date FROM bal WHERE {_KNOWN_BAL}) e JOIN (SELECT security_id, year AS fy, p, r, year_end - k AS target FROM c, (VALUES ('FY', 0, 0), ('Q3', 91, 1), ('Q2', 182, 2), ('Q1', 273, 3)) AS o(p, k, r)) t USING (security_id) WHERE abs(end_date - target) <= 15 QUALIFY row_number() OVER (PARTITION BY security_id, end_date ORDER BY abs(end_date - target), fy, r) = 1", "inc0", "bal", c=_CAL),
    "nrm6_income_statement": sql(f"SELECT security_id, fiscal_year, period, end_date, accepted_date, filing_date, {', '.join(_INC_FIELDS)} FROM inc0 WHERE coalesce(revenue, gross_profit, ebit, net_income, eps_diluted) IS NOT NULL", "inc0"),
    "nrm6_balance_sheet": sql(f"SELECT security_id, fiscal_year, period, end_date, accepted_date, filing_date, {', '.join(f if f in ('total_assets', 'total_equity', 'long_term_debt') else f'{_NULLS} AS {f}' for f in _BAL_FIELDS)} FROM bal WHERE {_KNOWN_BAL}", "bal"),
    "nrm7_fourth_quarters": sql("SELECT security_id, fiscal_year, period, end_date, accepted_date, round(revenue, 2) AS revenue, round(gross_profit, 2) AS gross_profit, round(ebit, 2) AS ebit, round(net_income, 2) AS net_income, eps_diluted FROM inc WHERE period = 'Q4'", "inc"),
    "nrm8_normalised_counts": sql(f"SELECT * FROM ({_COUNTS})", "inc", "bal", "cf"),
    "ts1_unsplit": sql("SELECT security_id, date, round(open * f, 6) AS open, round(high * f, 6) AS high, round(low * f, 6) AS low, round(close * f, 6) AS close, CAST(round_even(volume / f, 0) AS BIGINT) AS volume FROM (SELECT *, (CASE WHEN date < DATE '1998-06-15' THEN 2e0 ELSE 1e0 END) * (CASE WHEN date < DATE '2000-02-01' THEN 1.5e0 ELSE 1e0 END) AS f FROM px)", "px"),
    "cns1_label_dates": sql("SELECT security_id, pulled_at, period, target_date FROM e", "est0", e=_EST),
    "cns2_estimate_rows": sql(_EST_OK, "est0"),
    "jn1_anchor_join": sql("SELECT cik, fiscal_year, 'revenue' AS field, round(expected, 2) AS expected, round(revenue, 2) AS actual, abs(revenue - expected) <= 0.005 * abs(expected) AS ok FROM (SELECT security_id, fiscal_year, revenue, revenue * CASE WHEN CAST(security_id AS INT) % 4 = 0 THEN 1.01e0 ELSE 1.001e0 END AS expected FROM inc WHERE period = 'FY' AND fiscal_year % 5 = 1 QUALIFY row_number() OVER (PARTITION BY security_id, fiscal_year ORDER BY accepted_date DESC, end_date DESC) = 1) JOIN sec USING (security_id)", "inc", "sec"),
}
