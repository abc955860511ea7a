"""The feature registry: each feature is a column expression over what was known at a grid point.

A statement reaches an expression as an array of structs, one for each period known at the date, latest first
by (end_date, period, fiscal_year); so at a year's end the fourth quarter comes before the full year. Only the
fields that the requested features name are in the structs. Prices reach it as ready columns. An author can thus
not read what was not known.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import pit
from tidemark.schema import FIELDS, value_columns

#: Names of the statements within expressions.
SHORT = {"inc": "income_statement", "bal": "balance_sheet", "cf": "cashflow"}
# Days of a trailing year, the span of four quarters, price look-backs in days and rows.
RECENT_DAYS, SPAN_DAYS = 366, (200, 320)
RETURN_DAYS = {"return_1m": 30, "return_3m": 90, "return_6m": 180, "return_12m": 365}
VOLATILITY_ROWS = {"volatility_30d": 30, "volatility_90d": 90}
DRAWDOWN_DAYS = 365
# Sector features and their labels.
SECTORS = {
    "sector_energy": "Energy",
    "sector_materials": "Materials",
    "sector_industrials": "Industrials",
    "sector_consumer_discretionary": "Consumer Discretionary",
    "sector_consumer_defensive": "Consumer Defensive",
    "sector_healthcare": "Healthcare",
    "sector_financial_services": "Financial Services",
    "sector_technology": "Technology",
    "sector_communication_services": "Communication Services",
    "sector_utilities": "Utilities",
    "sector_real_estate": "Real Estate",
}


@dataclass(frozen=True)
class Feature:
    """A named expression, the tables it reads, and the share of samples that must have it."""

    name: str
    expression: str
    tables: tuple[str, ...]
    description: str = ""
    min_coverage: float = 0.0
    required: bool = False
    experimental: bool = False


class Registry:
    """Features by name, in order of registration."""

    def __init__(self, features: Iterable[Feature] = ()):
        self._by_name: dict[str, Feature] = {}
        for f in features:
            self.register(f)

    def register(self, feature: Feature) -> None:
        if feature.name in self._by_name:
            raise ValueError(f"feature registered twice: {feature.name}")
        self._by_name[feature.name] = feature

    def names(self) -> list[str]:
        return list(self._by_name)

    def __getitem__(self, name: str) -> Feature:
        return self._by_name[name]

    def __len__(self) -> int:
        return len(self._by_name)

    def select(self, names: Iterable[str]) -> "Registry":
        """The named features; ValueError for unknown ones."""
        wanted = list(names)
        unknown = [n for n in wanted if n not in self._by_name]
        if unknown:
            raise ValueError(f"unknown features: {unknown}")
        return Registry(self._by_name[n] for n in wanted)

    def validate(self, tables: dict[str, DataFrame]) -> list[str]:
        """Names of required features whose tables are missing."""
        return [f.name for f in self._by_name.values() if f.required and not set(f.tables) <= set(tables)]


def _first(t: str, where: str) -> str:
    return f"get(filter({t}, r -> {where}), 0)"


def latest(t: str, f: str) -> str:
    """The latest non-null value of a field."""
    return f"{_first(t, f'r.{f} is not null')}.{f}"


def both(t: str, a: str, b: str) -> str:
    """The latest row that has two fields."""
    return _first(t, f"r.{a} is not null and r.{b} is not null")


def ratio(t: str, a: str, b: str) -> str:
    row = both(t, a, b)
    return f"try_divide({row}.{a}, {row}.{b})"


def _quarters(t: str, f: str) -> str:
    return f"filter({t}, r -> r.period like 'Q%' and r.{f} is not null)"


def _sum(q: str, f: str, start: int) -> str:
    return f"aggregate(slice({q}, {start}, 4), 0D, (s, r) -> s + r.{f})"


def ttm(t: str, f: str) -> str:
    """The trailing year: the latest full year if it is recent and has the field, else four consecutive quarters."""
    year, q = _first(t, "r.period = 'FY'"), _quarters(t, f)
    annual = f"case when datediff(as_of_date, {year}.end_date) <= {RECENT_DAYS} then {year}.{f} end"
    whole = f"size({q}) >= 4 and datediff(get({q}, 0).end_date, get({q}, 3).end_date) between {SPAN_DAYS[0]} and {SPAN_DAYS[1]} and datediff(as_of_date, get({q}, 0).end_date) <= {RECENT_DAYS}"
    return f"coalesce({annual}, case when {whole} then {_sum(q, f, 1)} end)"


def yoy(t: str, f: str, by_quarters: bool = False) -> str:
    """Growth of the last full year over the one before; with ``by_quarters`` of four quarters where years are missing."""
    years = f"filter({t}, r -> r.period = 'FY' and r.{f} is not null)"
    annual = f"try_divide(get({years}, 0).{f} - get({years}, 1).{f}, get({years}, 1).{f})"
    if not by_quarters:
        return f"case when size({years}) >= 2 then {annual} end"
    q = _quarters(t, f)
    spans = " and ".join(f"datediff(get({q}, {k}).end_date, get({q}, {k + 3}).end_date) between {SPAN_DAYS[0]} and {SPAN_DAYS[1]}" for k in (0, 4))
    moved = f"try_divide({_sum(q, f, 1)} - {_sum(q, f, 5)}, {_sum(q, f, 5)})"
    return f"case when size({years}) >= 2 then {annual} when size({q}) >= 8 and {spans} then {moved} end"


def _year(t: str, k: int) -> str:
    return f"get(filter({t}, r -> r.period = 'FY'), {k})"


def _known(*values: str) -> str:
    return " and ".join(f"{v} is not null" for v in values)


def _signals(conditions: list[str], *values: str) -> str:
    score = " + ".join(f"cast({c} as double)" for c in conditions)
    return f"case when {_known(*values)} then {score} end"


def _composites() -> dict[str, str]:
    inc, prior_inc, bal, prior, cf = _year("inc", 0), _year("inc", 1), _year("bal", 0), _year("bal", 1), _year("cf", 0)
    cfo, ni, ta, ta0 = f"{cf}.operating_cash_flow", f"{inc}.net_income", f"{bal}.total_assets", f"{prior}.total_assets"
    cr, cr0 = (f"try_divide({r}.current_assets, {r}.current_liabilities)" for r in (bal, prior))
    roa, roa0 = f"try_divide({ni}, {ta})", f"try_divide({prior_inc}.net_income, {ta0})"
    cogs = f"({inc}.revenue - {inc}.gross_profit)"
    one = lambda r, f: f"{r}.{f}"
    gm, gm0 = (f"try_divide({r}.gross_profit, {r}.revenue)" for r in (inc, prior_inc))
    aq, aq0 = (f"(1 - try_divide({r}.current_assets + {r}.ppe, {r}.total_assets))" for r in (bal, prior))
    dep, dep0 = (f"try_divide({c}.depreciation, {c}.depreciation + {b}.ppe)" for c, b in ((cf, bal), (_year("cf", 1), prior)))
    sga, sga0 = (f"try_divide({r}.sga, {r}.revenue)" for r in (inc, prior_inc))
    lev, lev0 = (f"try_divide({r}.long_term_debt + {r}.current_liabilities, {r}.total_assets)" for r in (bal, prior))
    dsr, dsr0 = (f"try_divide({b}.receivables, {i}.revenue)" for b, i in ((bal, inc), (prior, prior_inc)))
    # The coefficients of the eight-variable score.
    terms = [("0.92", f"try_divide({dsr}, {dsr0})"), ("0.528", f"try_divide({gm0}, {gm})"), ("0.404", f"try_divide({aq}, {aq0})"), ("0.892", f"try_divide({one(inc, 'revenue')}, {one(prior_inc, 'revenue')})"), ("0.115", f"try_divide({dep0}, {dep})"), ("-0.172", f"try_divide({sga}, {sga0})"), ("4.679", f"try_divide({ni} - {cfo}, {ta})"), ("-0.327", f"try_divide({lev}, {lev0})")]
    return {
        "piotroski_f_score": _signals([f"{roa} > 0", f"{cfo} > 0", f"{cfo} > {ni}", f"{cr} > {cr0}"], roa, cfo, ni, cr, cr0),
        "ccc_days": f"case when {cogs} > 0 and {inc}.revenue > 0 then 365D * ({bal}.inventory / {cogs} + {bal}.receivables / {inc}.revenue - {bal}.payables / {cogs}) end",
        "dechow_accruals": f"case when ({ta} + {ta0}) / 2 > 0 then ({ni} - {cfo}) / (({ta} + {ta0}) / 2) end",
        "beneish_m_score": " + ".join(["-4.84D", *(f"{w}D * {x}" for w, x in terms)]),
        "mohanram_g_score": _signals([f"{roa} > 0", f"try_divide({cfo}, {ta}) > 0", f"{cfo} > {ni}", f"{roa} > {roa0}"], roa, roa0, cfo, ni),
    }


EARNINGS_QUALITY = ("piotroski_f_score", "ccc_days", "dechow_accruals", "beneish_m_score", "mohanram_g_score")
EXPERIMENTAL = {"gross_profit_latest", "gross_profit_ttm", "gross_margin", *EARNINGS_QUALITY}


def _builtin() -> Iterable[Feature]:
    tables = {"inc": "income_statement", "bal": "balance_sheet", "cf": "cashflow", "price": "prices", "sector": "securities"}

    def make(name: str, expression: str, floor: float, *extra: str) -> Feature:
        used = [tables[t] for t in tables if re.search(rf"\b{t}\b", expression)] + [*extra]
        return Feature(name, expression, tuple(dict.fromkeys(used)), name.replace("_", " "), floor, experimental=name in EXPERIMENTAL)

    for name, f, floor in (("revenue_latest", "revenue", 0.85), ("net_income_latest", "net_income", 0.95), ("ebit_latest", "ebit", 0.85), ("gross_profit_latest", "gross_profit", 0.55), ("eps_diluted_latest", "eps_diluted", 0.65)):
        yield make(name, latest("inc", f), floor)
    for name, f, floor in (("total_assets_latest", "total_assets", 0.85), ("total_equity_latest", "total_equity", 0.90), ("cash_and_equivalents_latest", "cash_and_equivalents", 0.75), ("current_assets_latest", "current_assets", 0.70), ("current_liabilities_latest", "current_liabilities", 0.70), ("long_term_debt_latest", "long_term_debt", 0.65)):
        yield make(name, latest("bal", f), floor)
    for name, f in (("operating_cf_latest", "operating_cash_flow"), ("investing_cf_latest", "investing_cash_flow"), ("financing_cf_latest", "financing_cash_flow"), ("capex_latest", "capital_expenditure")):
        yield make(name, latest("cf", f), 0.80)
    for name, floor in (("close_latest", 0.95), ("return_1m", 0.90), ("return_3m", 0.85), ("return_6m", 0.80), ("return_12m", 0.75), ("volatility_30d", 0.85), ("volatility_90d", 0.80), ("max_drawdown_1y", 0.75)):
        yield make(name, f"price.{name}", floor)
    for name, label in SECTORS.items():
        yield make(name, f"case when sector is not null then cast(lower(sector) = '{label.lower()}' as double) end", 0.95)
    for name, f, floor in (("revenue_ttm", "revenue", 0.95), ("net_income_ttm", "net_income", 0.95), ("ebit_ttm", "ebit", 0.86), ("gross_profit_ttm", "gross_profit", 0.58)):
        yield make(name, ttm("inc", f), floor)
    yield make("revenue_yoy", yoy("inc", "revenue", True), 0.95)
    for name, f, floor in (("net_income_yoy", "net_income", 0.95), ("ebit_yoy", "ebit", 0.88), ("eps_yoy", "eps_diluted", 0.81)):
        yield make(name, yoy("inc", f), floor)
    for name, f, floor in (("gross_margin", "gross_profit", 0.58), ("ebit_margin", "ebit", 0.88), ("net_margin", "net_income", 0.95)):
        yield make(name, ratio("inc", f, "revenue"), floor)
    gap = both("bal", "total_assets", "total_equity")
    liabilities = f"coalesce({latest('bal', 'total_liabilities')}, {gap}.total_assets - {gap}.total_equity)"
    yield make("total_liabilities_latest", liabilities, 0.95)
    yield make("equity_to_assets", ratio("bal", "total_equity", "total_assets"), 0.95)
    yield make("liabilities_to_assets", f"try_divide({liabilities}, {latest('bal', 'total_assets')})", 0.95)
    yield make("current_ratio", ratio("bal", "current_assets", "current_liabilities"), 0.81)
    yield make("debt_to_equity", ratio("bal", "long_term_debt", "total_equity"), 0.86)
    yield make("debt_to_assets", ratio("bal", "long_term_debt", "total_assets"), 0.86)
    free = both("cf", "operating_cash_flow", "capital_expenditure")
    yield make("fcf_latest", f"{free}.operating_cash_flow - {free}.capital_expenditure", 0.77)
    yield make("operating_cf_ttm", ttm("cf", "operating_cash_flow"), 0.89)
    yield make("capex_ttm", ttm("cf", "capital_expenditure"), 0.77)
    yield make("fcf_ttm", f"{ttm('cf', 'operating_cash_flow')} - {ttm('cf', 'capital_expenditure')}", 0.72)
    earned = latest("inc", "net_income")
    yield make("return_on_assets", f"try_divide({earned}, {latest('bal', 'total_assets')})", 0.95)
    yield make("return_on_equity", f"try_divide({earned}, {latest('bal', 'total_equity')})", 0.95)
    yield make("return_on_invested_capital", f"try_divide({earned}, {latest('bal', 'total_equity')} + {latest('bal', 'long_term_debt')})", 0.86)
    yield make("pe_ratio_ttm", f"try_divide(price.close_latest, {ttm('inc', 'eps_diluted')})", 0.79)
    for name, expression in _composites().items():
        yield make(name, expression, 0.0)


BUILTIN = Registry(_builtin())


def price_features(grid: DataFrame, prices: DataFrame, column: str = "close") -> DataFrame:
    """The grid with its price features. Rolling figures are computed once a quote and looked up at each date."""
    quotes = prices.where(F.col(column).isNotNull()).select("security_id", "date", F.col(column).alias("close"))
    w = Window.partitionBy("security_id").orderBy("date")
    moves = quotes.withColumn("_was", F.lag("close").over(w)).withColumn("_row", F.row_number().over(w))
    moves = moves.withColumn("_bad", (F.col("_was") == 0) & (F.col("close") != 0)).withColumn("_move", F.when(F.col("_was") != 0, (F.col("close") - F.col("_was")) / F.col("_was")))
    for name, n in VOLATILITY_ROWS.items():
        last = w.rowsBetween(-(n - 1), Window.currentRow)
        clean = (F.col("_row") > n) & (F.max(F.col("_bad").cast("int")).over(last) == 0)
        moves = moves.withColumn(name, F.when(clean, F.stddev_samp("_move").over(last)))
    seen = pit.prices(grid, moves)
    then = {k: F.max_by("close", F.when(F.col("date") <= F.date_sub("as_of_date", d), F.col("date"))).alias(f"_{k}") for k, d in RETURN_DAYS.items()}
    now = seen.groupBy(*pit.GRID).agg(F.max_by("close", "date").alias("close_latest"), *then.values(), *[F.max_by(v, "date").alias(v) for v in VOLATILITY_ROWS])
    now = now.select(*pit.GRID, "close_latest", *[F.expr(f"try_divide(close_latest - _{k}, _{k})").alias(k) for k in RETURN_DAYS], *VOLATILITY_ROWS)
    year = pit.prices(grid, quotes).where(F.col("date") >= F.date_sub("as_of_date", DRAWDOWN_DAYS))
    top = Window.partitionBy(*pit.GRID).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    falls = year.withColumn("_top", F.max("close").over(top)).groupBy(*pit.GRID).agg(F.min(F.expr("try_divide(close - _top, _top)")).alias("max_drawdown_1y"))
    return now.join(falls, pit.GRID, "left")


def matrix(grid: DataFrame, tables: dict[str, DataFrame], registry: Registry = BUILTIN) -> DataFrame:
    """The grid with one column a feature. Points are computed once, however often the grid repeats them."""
    points = pit.keys_of(grid)
    wide = points
    text = " ".join(registry[n].expression for n in registry.names())
    for short, name in SHORT.items():
        if not re.search(rf"\b{short}\b", text):
            continue
        table = tables[name]
        known = value_columns(table)
        named = sorted(f for f in {*sum(FIELDS.values(), []), "sga", "receivables", "ppe", "inventory", "payables", "depreciation"} if re.search(rf"\b{f}\b", text))
        fields = [F.col(f) if f in known else F.lit(None).cast("double").alias(f) for f in named if f in known or f in FIELDS[name] or f not in sum(FIELDS.values(), [])]
        rows = pit.series(points, table.select(*[c for c in table.columns if c not in known or c in named]))
        each = F.sort_array(F.collect_list(F.struct("end_date", "period", "fiscal_year", *fields)), asc=False).alias(short)
        wide = wide.join(rows.groupBy(*pit.GRID).agg(each), pit.GRID, "left")
    if re.search(r"\bprice\b", text):
        quoted = price_features(points, tables["prices"])
        wide = wide.join(quoted.select(*pit.GRID, F.struct(*[c for c in quoted.columns if c not in pit.GRID]).alias("price")), pit.GRID, "left")
    if re.search(r"\bsector\b", text):
        wide = wide.join(pit.sectors(points, tables["securities"]), pit.GRID, "left")
    values = wide.select(*pit.GRID, *[F.expr(registry[n].expression).cast("double").alias(n) for n in registry.names()])
    return grid.join(values, pit.GRID, "left").select(*grid.columns, *registry.names())


def inference_panel(securities: DataFrame, tables: dict[str, DataFrame], as_of, names: Iterable[str]) -> DataFrame:
    """The named features of some securities at one date; a security without a symbol is called UNKNOWN."""
    registry = BUILTIN.select(names)
    grid = securities.select("security_id", F.coalesce("symbol", F.lit("UNKNOWN")).alias("symbol"), F.lit(as_of).cast("date").alias("as_of_date"))
    return matrix(grid, tables, registry)
