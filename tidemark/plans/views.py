"""Statements, prices and estimates derived from the star-schema tables, for the registered queries.

A nation is a security and its orders are its business: amounts by order quarter and year, known when the
goods have shipped, so later shipments restate earlier figures. The same SQL text makes the views for both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark import folders


def _sum(what: str, when: str | None = None) -> str:
    return f"CAST(sum({what if when is None else f'CASE WHEN {when} THEN {what} END'}) AS DOUBLE) / 100e0"


INCOME = {
    "revenue": _sum("cents"),
    "gross_profit": _sum("cents", "l_returnflag = 'R'"),
    "ebitda": "CAST(NULL AS DOUBLE)",
    "ebit": _sum("cents", "l_linestatus = 'F'"),
    "net_income": _sum("CASE WHEN l_tax > 0.035 THEN cents ELSE -cents END"),
    "eps_diluted": _sum("qty", "l_returnflag = 'A'"),
    "sga": _sum("cents", "l_discount < 0.035"),
}
BALANCE = {
    "total_assets": _sum("4 * cents"),
    "total_liabilities": _sum("cents", "l_linestatus = 'O' AND qty > 45"),
    "total_equity": _sum("cents", "l_returnflag <> 'R'"),
    "cash_and_equivalents": _sum("cents", "l_discount > 0.075"),
    "current_assets": _sum("cents", "qty > 20"),
    "current_liabilities": _sum("cents", "qty < 25"),
    "long_term_debt": _sum("cents", "l_tax < 0.025"),
    "receivables": _sum("cents", "l_discount BETWEEN 0.015 AND 0.055"),
    "ppe": _sum("cents", "qty > 35"),
    "inventory": _sum("cents", "l_tax > 0.055"),
    "payables": _sum("cents", "qty < 15"),
}
CASH = {
    "operating_cash_flow": _sum("CASE WHEN l_discount > 0.015 THEN cents ELSE -cents END"),
    "investing_cash_flow": _sum("-cents", "qty > 30"),
    "financing_cash_flow": _sum("CASE WHEN l_tax > 0.055 THEN cents ELSE -cents END"),
    "capital_expenditure": _sum("cents", "qty < 15"),
    "free_cash_flow": "CAST(NULL AS DOUBLE)",
    "depreciation": _sum("cents", "l_tax BETWEEN 0.025 AND 0.055"),
}
KEY = "security_id, fiscal_year, period, end_date, accepted_date, filing_date"

LINES = """
SELECT CAST(c_nationkey AS STRING) AS security_id, CAST(year(o_orderdate) AS INT) AS fiscal_year, CAST(quarter(o_orderdate) AS INT) AS q,
       CAST(last_day(CAST(l_shipdate AS DATE)) AS DATE) AS shipped, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS qty,
       l_discount, l_tax, l_returnflag, l_linestatus
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey"""

DATED = """
SELECT *, concat('Q', CAST(q AS STRING)) AS period, CAST(last_day(make_date(fiscal_year, q * 3, 1)) AS DATE) AS end_date FROM {lines} WHERE q < 4
UNION ALL SELECT *, 'FY' AS period, make_date(fiscal_year, 12, 31) AS end_date FROM {lines}"""


def _versions(fields: dict[str, str]) -> str:
    sums = ", ".join(f"{v} AS {k}" for k, v in fields.items())
    return f"SELECT security_id, fiscal_year, period, end_date, greatest(shipped, end_date) AS accepted_date, greatest(shipped, end_date) AS filing_date, {sums} FROM {{dated}} GROUP BY security_id, fiscal_year, period, end_date, greatest(shipped, end_date)"


SECURITIES = """
SELECT CAST(n_nationkey AS STRING) AS security_id, n_name AS symbol, lpad(CAST(n_nationkey AS STRING), 10, '0') AS cik,
       CASE r_name WHEN 'AFRICA' THEN 'Energy' WHEN 'AMERICA' THEN 'Technology' WHEN 'ASIA' THEN 'FINANCIAL services' WHEN 'EUROPE' THEN 'Healthcare' ELSE '  ' END AS sector,
       'misc' AS industry, r_name AS country, 'X' AS exchange
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""

PRICES = """
SELECT CAST(user_id % 25 AS STRING) AS security_id, DATE '1996-01-01' + CAST(event_id * 7919 % 2200 AS INT) AS date, max(value) AS open, max(value) AS high, min(value) AS low,
       CASE WHEN max(event_id) % 41 = 0 THEN NULL ELSE max(value) END AS close, max(value) AS adj_close, count(*) AS volume
FROM {events} GROUP BY user_id % 25, DATE '1996-01-01' + CAST(event_id * 7919 % 2200 AS INT)"""

RAW_ESTIMATES = """
SELECT CAST(user_id % 25 AS STRING) AS security_id, ts AS pulled_at, CASE event_id % 5 WHEN 0 THEN '0q' WHEN 1 THEN '+1q' WHEN 2 THEN '0y' WHEN 3 THEN '+1y' ELSE 'zz' END AS period,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS avg, CAST(event_id % 7 AS INT) AS numberOfAnalysts, CASE WHEN event_id % 2 = 0 THEN 'eps' ELSE 'revenue' END AS metric
FROM {events}"""

FORECASTS = """
SELECT l_extendedprice AS actual, CASE WHEN l_linenumber = 7 AND l_quantity > 40 THEN NULL ELSE l_extendedprice * (0.9 + l_discount * 2) + (l_quantity - 25) * 100 END AS prediction,
       l_extendedprice * (1 + (l_tax - 0.04)) AS naive, l_extendedprice - 5000 AS lower, l_extendedprice + (l_quantity - 20) * 100 AS upper, l_returnflag AS model,
       CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS BIGINT) AS horizon_days
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""


class Views:
    """The views over one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._held: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived table, made once and read from the shared folder from then on: queries use it many times over."""
        if name not in self._held:
            self._held[name] = folders.held(make(), name)
        return self._held[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)

    def _dated(self) -> DataFrame:
        lines = self._sql(LINES, lineitem=self.table("lineitem"), orders=self.table("orders"), customer=self.table("customer"))
        return self._sql(DATED, lines=lines)

    def reported(self, fields: dict[str, str]) -> DataFrame:
        """Versions as reported, without fourth quarters."""
        return self._sql(_versions(fields), dated=self._dated())

    def reported_income(self) -> DataFrame:
        return self._once("reported_income", lambda: self.reported(INCOME))

    def income(self) -> DataFrame:
        from tidemark.operators.normalize import fourth_quarters

        def whole() -> DataFrame:
            base = self.reported_income()
            return base.unionByName(fourth_quarters(base))

        return self._once("income", whole)

    def balance(self) -> DataFrame:
        return self._once("balance", lambda: self.reported(BALANCE))

    def cash(self) -> DataFrame:
        from tidemark.operators.normalize import fourth_quarters

        def whole() -> DataFrame:
            base = self._once("reported_cash", lambda: self.reported(CASH))
            return base.unionByName(fourth_quarters(base))

        return self._once("cash", whole)

    def securities(self) -> DataFrame:
        return self._sql(SECURITIES, nation=self.table("nation"), region=self.table("region"))

    def prices(self) -> DataFrame:
        return self._once("prices", lambda: self._sql(PRICES, events=self.table("events")))

    def raw_estimates(self) -> DataFrame:
        return self._sql(RAW_ESTIMATES, events=self.table("events"))

    def forecasts(self) -> DataFrame:
        text = FORECASTS.replace("date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))", "datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))")
        return self._sql(text, lineitem=self.table("lineitem"), orders=self.table("orders"))

    def tables(self) -> dict[str, DataFrame]:
        return {"income_statement": self.income(), "balance_sheet": self.balance(), "cashflow": self.cash(), "prices": self.prices(), "securities": self.securities()}


def _q4(table: str, flows: list[str], others: list[str], order: list[str]) -> str:
    """SQL for the fourth quarters of a view."""
    taken = ", ".join(f"any_value(q_{f}) FILTER (qp = '{p}') AS {p}_{f}" for p in ("Q1", "Q2", "Q3") for f in flows)
    cols = {f: f"(f.{f} - Q1_{f} - Q2_{f} - Q3_{f})" for f in flows} | {f: "CAST(NULL AS DOUBLE)" for f in others}
    return f"""
SELECT f.security_id, f.fiscal_year, 'Q4' AS period, f.end_date, f.accepted_date, f.filing_date, {", ".join(f"{cols[f]} AS {f}" for f in order)}
FROM (SELECT * FROM {table} WHERE period = 'FY') f
JOIN (SELECT security_id, fiscal_year, accepted_date, {taken} FROM
        (SELECT f.security_id, f.fiscal_year, f.accepted_date, q.period AS qp, {", ".join(f"q.{f} AS q_{f}" for f in flows)}
         FROM {table} f JOIN {table} q ON q.security_id = f.security_id AND q.fiscal_year = f.fiscal_year AND q.accepted_date <= f.accepted_date
         WHERE f.period = 'FY' AND q.period <> 'FY'
         QUALIFY row_number() OVER (PARTITION BY f.security_id, f.fiscal_year, f.accepted_date, q.period ORDER BY q.accepted_date DESC, q.end_date DESC) = 1)
      GROUP BY ALL HAVING count(DISTINCT qp) = 3) t
USING (security_id, fiscal_year, accepted_date)
WHERE coalesce({", ".join(cols[f] for f in flows)}) IS NOT NULL"""


def _duck(text: str) -> str:
    return text.format(lineitem="lineitem", orders="orders", customer="customer", nation="nation", region="region", events="events", lines="v_lines", dated="v_dated")


_INC_FLOWS, _CF_FLOWS = [c for c in INCOME if c != "eps_diluted"], list(CASH)
_PARTS = {
    "v_lines": (_duck(LINES), []),
    "v_dated": (_duck(DATED), ["v_lines"]),
    "inc0": (_duck(_versions(INCOME)), ["v_dated"]),
    "bal": (_duck(_versions(BALANCE)), ["v_dated"]),
    "cf0": (_duck(_versions(CASH)), ["v_dated"]),
    "inc": (f"SELECT * FROM inc0 UNION ALL BY NAME ({_q4('inc0', _INC_FLOWS, ['eps_diluted'], list(INCOME))})", ["inc0"]),
    "cf": (f"SELECT * FROM cf0 UNION ALL BY NAME ({_q4('cf0', _CF_FLOWS, [], list(CASH))})", ["cf0"]),
    "sec": (_duck(SECURITIES), []),
    "px": (_duck(PRICES), []),
    "est0": (_duck(RAW_ESTIMATES), []),
    "fc": (_duck(FORECASTS), []),
    "grid": ("SELECT security_id, min(accepted_date) AS as_of_date FROM inc WHERE period = 'FY' GROUP BY security_id, fiscal_year", ["inc"]),
}


def sql(body: str, *views: str, **more: str) -> str:
    """A DuckDB query with the views it names, and further named parts, in front."""
    names: list[str] = []

    def need(v: str) -> None:
        for x in _PARTS[v][1]:
            need(x)
        if v not in names:
            names.append(v)

    for v in views:
        need(v)
    parts = [f"{v} AS MATERIALIZED ({_PARTS[v][0]})" for v in names] + [f"{k} AS ({v})" for k, v in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
