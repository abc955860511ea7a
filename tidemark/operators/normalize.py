"""From disclosed facts to statement tables that keep every restatement.

Facts are rows (security_id, concept, start, end, filed, value, unit, form, fp). All securities are
normalised in one plan, partitioned by security: fiscal calendar, labels, concept priorities, and the
fourth quarter as the full year less three quarters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import folders
from tidemark.schema import FIELDS, NOT_VALUES, TABLES

# The us-gaap concepts of each field, first choice first.
CONCEPTS = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet", "SalesRevenueGoodsNet"],
    "gross_profit": ["GrossProfit"],
    "ebitda": [],
    "ebit": ["OperatingIncomeLoss", "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest"],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "eps_diluted": ["EarningsPerShareDiluted", "IncomeLossFromContinuingOperationsPerDilutedShare"],
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "total_equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "cash_and_equivalents": ["CashAndCashEquivalentsAtCarryingValue", "Cash"],
    "current_assets": ["AssetsCurrent"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "long_term_debt": ["LongTermDebt", "LongTermDebtNoncurrent"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities"],
    "investing_cash_flow": ["NetCashProvidedByUsedInInvestingActivities"],
    "financing_cash_flow": ["NetCashProvidedByUsedInFinancingActivities"],
    "capital_expenditure": ["PaymentsToAcquirePropertyPlantAndEquipment"],
    "free_cash_flow": [],
}
# Forms and fiscal periods that make a period.
ANNUAL_FORMS, QUARTERLY_FORMS = ("10-K", "10-K/A"), ("10-Q", "10-Q/A")
# Days of a full year and of a quarter, how far an instant may lie from a period's end, and the quarters' distances before it.
YEAR_DAYS, QUARTER_DAYS, NEAR_DAYS = (340, 380), (60, 100), 15
BEFORE_YEAR_END = {"FY": 0, "Q3": 91, "Q2": 182, "Q1": 273}
#: Fields that add up over a year, so that a fourth quarter can be derived.
FLOWS = ["revenue", "gross_profit", "ebitda", "ebit", "net_income", *FIELDS["cashflow"]]


def unit_of(field: str) -> str:
    """The unit that a field's facts must have."""
    return "USD/shares" if field == "eps_diluted" else "USD"


def period_of(form: Column, fp: Column) -> Column:
    """The period of a filing, null for others."""
    annual = form.isin(*ANNUAL_FORMS) & (fp == "FY")
    return F.when(annual, "FY").when(form.isin(*QUARTERLY_FORMS) & fp.isin("Q1", "Q2", "Q3"), fp)


def days_of(start: str = "start", end: str = "end") -> Column:
    return F.datediff(end, start) + 1


def right_length(period: str = "period") -> Column:
    """Whether a fact lasts as long as its period; instants and other periods pass."""
    year, quarter = days_of().between(*YEAR_DAYS), days_of().between(*QUARTER_DAYS)
    return F.when(F.col("start").isNull(), True).when(F.col(period) == "FY", year).when(F.col(period).isin("Q1", "Q2", "Q3"), quarter).otherwise(True)


def fiscal_calendar(facts: DataFrame) -> DataFrame:
    """(security_id, year, year_end): the last full-year end in each calendar year, else 91 days after third quarters."""
    timed = facts.where("start is not null")
    annual = timed.where(F.col("fp").eqNullSafe("FY") & F.col("form").isin(*ANNUAL_FORMS) & days_of().between(*YEAR_DAYS)).select("security_id", F.col("end").alias("year_end"), F.lit(0).alias("rank"))
    third = timed.where(F.col("fp").eqNullSafe("Q3") & F.col("form").isin(*QUARTERLY_FORMS) & days_of().between(*QUARTER_DAYS)).select("security_id", F.date_add("end", 91).alias("year_end"), F.lit(1).alias("rank"))
    both = annual.union(third)
    best = both.groupBy("security_id").agg(F.min("rank").alias("best"))
    kept = both.join(best, "security_id").where("rank = best")
    return kept.groupBy("security_id", F.year("year_end").alias("year")).agg(F.max("year_end").alias("year_end"))


def with_fiscal_year(rows: DataFrame, calendar: DataFrame, end: str = "end") -> DataFrame:
    """``rows`` with the fiscal year in which their end date falls."""
    this = calendar.select("security_id", F.col("year").alias("_y"), F.col("year_end").alias("_this"))
    after = calendar.select("security_id", (F.col("year") - 1).alias("_y"), F.col("year_end").alias("_next"))
    met = rows.withColumn("_y", F.year(end)).join(this, ["security_id", "_y"], "left").join(after, ["security_id", "_y"], "left")
    later = (F.col("_this").isNull() | (F.col("_this") < F.col(end))) & F.col("_next").isNotNull()
    return met.withColumn("fiscal_year", F.col("_y") + F.when(later, 1).otherwise(0)).drop("_y", "_this", "_next")


def classify_instants(instants: DataFrame, calendar: DataFrame) -> DataFrame:
    """Instants with the fiscal year and period whose end is nearest, within NEAR_DAYS; others go."""
    offsets = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.lit(n).alias("days"), F.lit(i).alias("rank")) for i, (p, n) in enumerate(BEFORE_YEAR_END.items())]))
    ends = calendar.select("security_id", F.col("year").alias("_fy"), "year_end", offsets.alias("o"))
    target = ends.select("security_id", "_fy", "o.period", "o.rank", F.expr("date_sub(year_end, o.days)").alias("_end"))
    points = instants.select("security_id", "end").distinct()
    near = points.join(target, "security_id").withColumn("_far", F.abs(F.datediff("end", "_end"))).where(F.col("_far") <= NEAR_DAYS)
    best = near.groupBy("security_id", "end").agg(F.min_by(F.struct("_fy", "period"), F.struct("_far", "_fy", "rank")).alias("b"))
    return instants.join(best.select("security_id", "end", F.col("b._fy").alias("fiscal_year"), F.col("b.period").alias("period")), ["security_id", "end"])


def priorities(spark: SparkSession, fields: list[str]) -> DataFrame:
    """(field, concept, priority, unit), a small table."""
    rows = [(f, c, i, unit_of(f)) for f in fields for i, c in enumerate(CONCEPTS[f])]
    return spark.createDataFrame(rows, "field string, concept string, priority int, unit string")


BUCKET = ["security_id", "fiscal_year", "period", "end", "filed"]


def labelled(facts: DataFrame, calendar: DataFrame) -> DataFrame:
    """Facts with fiscal year and period: flows by form and length, instants by the nearest period end."""
    flows = facts.where("start is not null").withColumn("period", period_of(F.col("form"), F.col("fp")))
    flows = with_fiscal_year(flows.where(F.col("period").isNotNull()).where(right_length()), calendar)
    instants = facts.where("start is null").where(period_of(F.col("form"), F.col("fp")).isNotNull())
    return flows.unionByName(classify_instants(instants, calendar))


def resolve(bucketed: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (bucket, field, concept, priority, value): each field's first concept in a bucket.

    Buckets of instants alone take facts of any fiscal period; in others the period must match.
    """
    spark = bucketed.sparkSession
    wanted = bucketed.join(F.broadcast(priorities(spark, fields)), ["concept", "unit"])
    alone = wanted.groupBy(*BUCKET).agg(F.bool_and(F.col("start").isNull()).alias("instants"))
    fits = wanted.join(alone, BUCKET).where(F.col("instants") | (F.col("fp") == F.col("period")))
    order = F.struct("priority", "start", "form", "value")
    best = fits.groupBy(*BUCKET, "field").agg(F.min_by(F.struct("concept", "priority", "value"), order).alias("b"))
    return best.select(*BUCKET, "field", "b.*")


def statements(facts: DataFrame, table: str) -> DataFrame:
    """The versions of one statement, without derived quarters."""
    return versions_of(labelled(facts, fiscal_calendar(facts)), table)


def versions_of(bucketed: DataFrame, table: str) -> DataFrame:
    """The versions of one statement from labelled facts."""
    fields = FIELDS[table]
    resolved = resolve(bucketed, fields)
    wide = resolved.groupBy(*BUCKET).pivot("field", fields).agg(F.first("value"))
    return wide.select("security_id", "fiscal_year", "period", F.col("end").alias("end_date"), F.col("filed").alias("accepted_date"), F.col("filed").alias("filing_date"), *[F.col(f).cast("double") for f in fields])


def fourth_quarters(table: DataFrame) -> DataFrame:
    """For each full-year version the year less its first three quarters as known then, where all three exist.

    A quarter's latest row counts as a whole: its null field makes the result null. Per-share values do not add up
    and stay null; rows without any value go.
    """
    fields = [c for c in table.columns if c not in NOT_VALUES]
    flows = [c for c in fields if c in FLOWS or c not in sum(FIELDS.values(), [])]
    year = table.where("period = 'FY'")
    quarters = table.where("period in ('Q1', 'Q2', 'Q3')").select("security_id", "fiscal_year", F.col("period").alias("_q"), F.col("accepted_date").alias("_acc"), F.col("end_date").alias("_end"), *[F.col(c).alias(f"_{c}") for c in flows])
    key = ["security_id", "fiscal_year", "accepted_date", "end_date"]
    met = year.select(*key).join(quarters, ["security_id", "fiscal_year"]).where("_acc <= accepted_date")
    chosen = F.struct(*[F.col(f"_{c}").alias(c) for c in flows])
    picks = [F.max_by(chosen, F.when(F.col("_q") == q, F.struct("_acc", "_end"))).alias(q) for q in ("Q1", "Q2", "Q3")]
    seen = [F.count(F.when(F.col("_q") == q, 1)).alias(f"n{q}") for q in ("Q1", "Q2", "Q3")]
    three = met.groupBy(*key).agg(*picks, *seen).where("nQ1 > 0 and nQ2 > 0 and nQ3 > 0")
    joined = year.join(three, key)
    value = lambda c: (F.col(c) - F.col(f"Q1.{c}") - F.col(f"Q2.{c}") - F.col(f"Q3.{c}")) if c in flows else F.lit(None).cast("double")
    out = joined.select("security_id", "fiscal_year", F.lit("Q4").alias("period"), "end_date", "accepted_date", "filing_date", *[value(c).alias(c) for c in fields])
    return out.where(F.coalesce(*[F.col(c) for c in flows]).isNotNull())


def normalise(facts: DataFrame) -> dict[str, DataFrame]:
    """The three statement tables; income and cash flow with their fourth quarters.

    Facts, calendar, labelled facts and versions are each computed once and kept in the shared folder: a single plan
    would hold the facts 288 times. The folder goes when the driver's JVM ends.
    """
    facts = folders.held(facts, "facts")
    bucketed = folders.held(labelled(facts, folders.held(fiscal_calendar(facts), "calendar")), "labelled")
    out = {}
    for name in FIELDS:
        base = folders.held(versions_of(bucketed, name), name)
        out[name] = base if name == "balance_sheet" else base.unionByName(fourth_quarters(base).select(*base.columns))
        out[name] = out[name].select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name]])
    return out


def concept_sources(facts: DataFrame, field: str, fiscal_year: int, fp: str) -> DataFrame:
    """Which concept, at which place of the list, a field comes from: at the latest end date of a year and period."""
    named = facts.where((F.col("fy") == fiscal_year) & (F.col("fp") == fp))
    wanted = named.join(F.broadcast(priorities(facts.sparkSession, [field])), ["concept", "unit"])
    last = wanted.groupBy("security_id").agg(F.max("end").alias("end"))
    best = wanted.join(last, ["security_id", "end"]).groupBy("security_id", "end").agg(F.min_by(F.struct("concept", "priority", "value"), F.struct("priority", -F.datediff("filed", F.lit("1970-01-01")), "start", "value")).alias("b"))
    return best.select("security_id", F.lit(field).alias("field"), "end", "b.concept", "b.priority", "b.value")


def anchor_check(income: DataFrame, securities: DataFrame, truth: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Truth rows (cik, fiscal_year, field, expected) with what the tables say and whether it is near enough.

    The tolerance is relative, absolute where nothing is expected; a field without expectation is skipped.
    """
    keyed = income.where("period = 'FY'").join(securities.select("security_id", "cik"), "security_id")
    last = keyed.groupBy("cik", "fiscal_year").agg(F.max_by(F.struct("revenue", "net_income", "eps_diluted"), F.struct("accepted_date", "end_date")).alias("r"))
    tall = last.selectExpr("cik", "fiscal_year", "stack(3, 'revenue', r.revenue, 'net_income', r.net_income, 'eps_diluted', r.eps_diluted) as (field, actual)")
    met = truth.where("expected is not null").join(tall, ["cik", "fiscal_year", "field"], "left")
    gap = F.abs(F.col("actual") - F.col("expected"))
    near = F.when(F.col("expected") == 0, gap <= tolerance).otherwise(gap <= tolerance * F.abs("expected"))
    return met.withColumn("ok", F.coalesce(near, F.lit(False)))
