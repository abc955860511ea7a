"""Forecast metrics as grouped aggregations.

Each metric takes a frame and the columns to group by (none: one row). A group without valid rows, or for which the
metric is undefined, gives null. Percentage errors count rows whose actual value is not near zero: at least
1e-3 and the 5 % quantile of the group's positive absolute actuals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Floor of the mask, its quantile, the levels of quantile forecasts, horizon buckets.
LEAST_ACTUAL, LEAST_QUANTILE = 1e-3, 0.05
LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
BUCKETS = (("short", 0, 200), ("medium", 200, 365), ("long", 365, 100_000))


def finite(name: str) -> Column:
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _pairs(rows: DataFrame, *names: str) -> DataFrame:
    keep = finite(names[0])
    for n in names[1:]:
        keep &= finite(n)
    return rows.where(keep)


def masked(rows: DataFrame, by: list[str], actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """Finite pairs whose actual value is large enough within its group."""
    pairs = _pairs(rows, actual, prediction)
    size = F.abs(F.col(actual))
    least = pairs.groupBy(*by).agg(F.greatest(F.lit(LEAST_ACTUAL), F.coalesce(F.percentile(F.when(size > 0, size), LEAST_QUANTILE), F.lit(LEAST_ACTUAL))).alias("_least"))
    met = pairs.join(F.broadcast(least), by) if by else pairs.crossJoin(F.broadcast(least))  # one row a group
    return met.where(size >= F.col("_least")).drop("_least")


def _ape(actual: str, prediction: str) -> Column:
    return F.abs((F.col(actual) - F.col(prediction)) / F.col(actual))


def mape(rows: DataFrame, by: list[str], actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    return masked(rows, by, actual, prediction).groupBy(*by).agg(F.avg(_ape(actual, prediction)).alias("mape"))


def median_ape(rows: DataFrame, by: list[str], actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    return masked(rows, by, actual, prediction).groupBy(*by).agg(F.median(_ape(actual, prediction)).alias("median_ape"))


def accuracy_within(rows: DataFrame, by: list[str], percent: float, actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """The share of errors of at most so many percent."""
    if percent < 0:
        raise ValueError("percent must not be negative")
    return masked(rows, by, actual, prediction).groupBy(*by).agg(F.avg((_ape(actual, prediction) <= percent / 100).cast("double")).alias("accuracy_within"))


def directional_accuracy(rows: DataFrame, by: list[str], reference: str, actual: str = "actual", prediction: str = "prediction", name: str = "directional_accuracy") -> DataFrame:
    """How often the forecast moves from the reference as the actual value did, where that moved at all."""
    moved = _pairs(rows, reference, actual, prediction).where(F.col(actual) != F.col(reference))
    same = F.signum(F.col(actual) - F.col(reference)) == F.signum(F.col(prediction) - F.col(reference))
    return moved.groupBy(*by).agg(F.avg(same.cast("double")).alias(name))


def beat_miss(rows: DataFrame, by: list[str], consensus: str = "consensus", actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """The same against the consensus."""
    return directional_accuracy(rows, by, consensus, actual, prediction, "beat_miss_accuracy")


def signed_errors(rows: DataFrame, by: list[str], actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """Mean, median, spread and skew of the signed relative error, and the shares above and below."""
    e = masked(rows, by, actual, prediction).withColumn("_e", (F.col(prediction) - F.col(actual)) / F.abs(F.col(actual)))
    skew = F.when((F.count("_e") >= 3) & (F.stddev_pop("_e") > 0), F.skewness("_e")).otherwise(F.lit(0.0))
    return e.groupBy(*by).agg(F.avg("_e").alias("spe_mean"), F.median("_e").alias("spe_median"), F.stddev_pop("_e").alias("spe_std"), skew.alias("spe_skew"), F.avg((F.col("_e") > 0).cast("double")).alias("pct_over"), F.avg((F.col("_e") < 0).cast("double")).alias("pct_under"))


def coverage(rows: DataFrame, by: list[str], prediction: str = "prediction") -> DataFrame:
    """The share of rows that have a forecast."""
    return rows.groupBy(*by).agg(F.avg(F.when(finite(prediction), 1.0).otherwise(0.0)).alias("coverage"))


def smape(rows: DataFrame, by: list[str], eps: float = 1e-8, actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    a, p = F.col(actual), F.col(prediction)
    return _pairs(rows, actual, prediction).groupBy(*by).agg(F.avg(2 * F.abs(a - p) / (F.abs(a) + F.abs(p) + eps)).alias("smape"))


def _pearson(x: str, y: str) -> Column:
    ok = (F.count("*") >= 2) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.covar_pop(x, y) / F.when(ok, F.stddev_pop(x) * F.stddev_pop(y)))))


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks from 1; ties share their mean rank."""
    order = Window.partitionBy(*[F.col(b) for b in by], F.lit(0)).orderBy(value)
    ties = Window.partitionBy(*[F.col(b) for b in by], F.col(value))
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2


def correlation(rows: DataFrame, by: list[str], method: str = "pearson", actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method: {method!r}")
    pairs = _pairs(rows, actual, prediction)
    x, y = actual, prediction
    if method == "spearman":
        pairs = pairs.withColumn("_rx", average_rank(actual, by)).withColumn("_ry", average_rank(prediction, by))
        x, y = "_rx", "_ry"
    return pairs.groupBy(*by).agg(_pearson(x, y).alias("correlation"))


def mase(rows: DataFrame, by: list[str], naive: str = "naive", actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """The error in units of the naive one, which must not be next to nothing."""
    a = F.col(actual)
    base = F.avg(F.abs(a - F.col(naive)))
    least = F.greatest(F.lit(1e-9), 1e-4 * F.avg(F.abs(a)))
    return _pairs(rows, actual, prediction, naive).groupBy(*by).agg(F.when(base >= least, F.avg(F.abs(a - F.col(prediction))) / F.when(base >= least, base)).alias("mase"))


def picp(rows: DataFrame, by: list[str], lower: str = "lower", upper: str = "upper", actual: str = "actual") -> DataFrame:
    """The share of actual values within their interval."""
    return _pairs(rows, lower, upper, actual).groupBy(*by).agg(F.avg(F.col(actual).between(F.col(lower), F.col(upper)).cast("double")).alias("picp"))


def _quantile_rows(rows: DataFrame, quantiles: str, levels: tuple[float, ...], actual: str) -> DataFrame:
    """The rows with a finite actual value and finite quantiles; another number of quantiles is an error."""
    right = F.when(F.size(quantiles) == len(levels), True).otherwise(F.raise_error(F.lit("a forecast has another number of quantiles")).cast("boolean"))
    known = F.forall(quantiles, lambda q: q.isNotNull() & ~F.isnan(q) & (F.abs(q) != float("inf")))
    return rows.where(F.col(quantiles).isNotNull()).where(right).where(finite(actual) & known)


def crps(rows: DataFrame, by: list[str], quantiles: str = "quantiles", levels: tuple[float, ...] = LEVELS, actual: str = "actual") -> DataFrame:
    """The mean over finite rows and levels of (level - [actual < q]) * (q - actual), and its negative, the pinball loss."""
    t = "array(" + ", ".join(f"{x}D" for x in levels) + ")"
    each = F.expr(f"aggregate(zip_with({quantiles}, {t}, (q, t) -> (t - case when {actual} < q then 1D else 0D end) * (q - {actual})), 0D, (s, x) -> s + x) / {len(levels)}")
    return _quantile_rows(rows, quantiles, levels, actual).groupBy(*by).agg(F.avg(each).alias("crps")).withColumn("pinball", -F.col("crps"))


def calibration(rows: DataFrame, by: list[str], quantiles: str = "quantiles", levels: tuple[float, ...] = LEVELS, actual: str = "actual") -> DataFrame:
    """For each level the share of finite actual values at or below the quantile."""
    t = F.array(*[F.lit(float(x)) for x in levels])
    each = _quantile_rows(rows, quantiles, levels, actual).select(*by, F.col(actual).alias("_a"), F.explode(F.arrays_zip(F.col(quantiles).alias("q"), t.alias("t"))).alias("x"))
    return each.groupBy(*by, F.col("x.t").alias("level")).agg(F.avg((F.col("_a") <= F.col("x.q")).cast("double")).alias("observed"))


def horizon_bucket(days: str = "horizon_days") -> Column:
    """Half-open buckets of the forecast horizon."""
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(BUCKETS):
        out = F.when((F.col(days) >= lo) & (F.col(days) < hi), name).otherwise(out)
    return out


def scoreboard(rows: DataFrame, models: dict[str, str], by: list[str], actual: str = "target_value", naive: str = "naive_baseline") -> DataFrame:
    """Eight metrics for each model, and group. ``models`` maps names to prediction columns."""
    stack = ", ".join(f"'{name}', {c}" for name, c in models.items())
    tall = rows.selectExpr(*by, f"{actual} as actual", f"{naive} as naive", f"stack({len(models)}, {stack}) as (model, prediction)")
    keys = ["model", *by]
    a, p, n = F.col("actual"), F.col("prediction"), F.col("naive")
    pair, size = finite("actual") & finite("prediction"), F.abs(F.col("actual"))
    least = tall.groupBy(*keys).agg(F.greatest(F.lit(LEAST_ACTUAL), F.coalesce(F.percentile(F.when(pair & (size > 0), size), LEAST_QUANTILE), F.lit(LEAST_ACTUAL))).alias("_least"))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    met = tall.alias("l").join(F.broadcast(least.alias("r")), on).select("l.*", "_least")  # one row a group
    ape = F.when(pair & (size >= F.col("_least")), _ape("actual", "prediction"))
    moved = pair & finite("naive") & (a != n)
    same = F.when(moved, (F.signum(a - n) == F.signum(p - n)).cast("double"))
    marked = met.select(*keys, ape.alias("_ape"), same.alias("_same"), finite("prediction").cast("double").alias("_known"), F.when(pair, a).alias("_a"), F.when(pair, p).alias("_p"))
    varied = (F.count("_a") >= 2) & (F.var_pop("_a") > 0) & (F.var_pop("_p") > 0)
    correlated = F.when(varied, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.covar_pop("_a", "_p") / F.when(varied, F.stddev_pop("_a") * F.stddev_pop("_p")))))
    within = lambda x: F.avg((F.col("_ape") <= x).cast("double"))
    return marked.groupBy(*keys).agg(F.avg("_ape").alias("mape"), F.median("_ape").alias("median_ape"), F.avg("_same").alias("directional_accuracy"), F.avg("_same").alias("beat_miss_accuracy"), within(0.1).alias("accuracy_within_10pct"), within(0.25).alias("accuracy_within_25pct"), F.avg("_known").alias("coverage"), correlated.alias("correlation"))


def lagged_pairs(panel: DataFrame, by: str = "symbol", order: str = "fiscal_year", value: str = "value") -> DataFrame:
    """Rows with the value before theirs (lagged) and the relative change (change); the first of each ``by`` has none and goes."""
    w = Window.partitionBy(by).orderBy(order)
    pairs = panel.withColumn("lagged", F.lag(value).over(w)).where("lagged is not null")
    return pairs.withColumn("change", F.expr(f"try_divide({value} - lagged, abs(lagged))"))


def lag_correlations(pairs: DataFrame, by: str = "symbol", value: str = "value") -> DataFrame:
    """(by, n, correlation) of a value with the one before; null with fewer than four pairs."""
    return pairs.groupBy(by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 4, _pearson(value, "lagged")).alias("correlation"))


def change_summary(pairs: DataFrame) -> DataFrame:
    """One row over all pairs: their number, correlation, and quartiles and median size of the relative change."""
    q = lambda x: F.percentile("change", x)
    return pairs.agg(F.count("*").alias("n"), _pearson("value", "lagged").alias("correlation"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.percentile(F.abs("change"), 0.5).alias("median_size"))


def correlation_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(one, other, correlation) for each pair of columns, over the rows in which all of them are finite; one pass."""
    whole = _pairs(rows, *columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    sums = whole.agg(*[_pearson(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    stack = ", ".join(f"'{a}', '{b}', _{i}" for i, (a, b) in enumerate(pairs))
    return sums.selectExpr(f"stack({len(pairs)}, {stack}) as (one, other, correlation)")


#: Slices of the value range that the distributions are summed in.
SLICES = 200


def two_sample_ks(one: DataFrame, other: DataFrame, value: str = "prediction") -> DataFrame:
    """One row: the greatest distance of two empirical distributions, both sizes, and the asymptotic p-value.

    Values are summed in slices of about equal size, each after those before it, so no task holds them all.
    """
    both = one.select(F.col(value).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(other.select(F.col(value), F.lit(0), F.lit(1))).where(finite("v"))
    counts = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    edges = both.agg(F.percentile_approx("v", [i / SLICES for i in range(1, SLICES)], 10_000)).first()[0] or []
    where = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col("v"))) if edges else F.lit(0)
    sliced = counts.withColumn("slice", where)
    sums = sliced.groupBy("slice").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))  # SLICES rows at most
    upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(0))
    before = sums.select("slice", (F.sum("sa").over(upto) - F.col("sa")).alias("a0"), (F.sum("sb").over(upto) - F.col("sb")).alias("b0"), F.sum("sa").over(whole).alias("n"), F.sum("sb").over(whole).alias("m"))
    within = Window.partitionBy("slice").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gaps = sliced.join(F.broadcast(before), "slice").select((F.expr("try_divide(1, n)") * (F.col("a0") + F.sum("a").over(within))).alias("x"), (F.expr("try_divide(1, m)") * (F.col("b0") + F.sum("b").over(within))).alias("y"), "n", "m")
    best = gaps.agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("statistic"), F.max("n").alias("n"), F.max("m").alias("m"))
    root = F.sqrt(F.expr("try_divide(n * m, n + m)"))
    z = (root + 0.12 + F.when(root > 0, 0.11 / F.when(root > 0, root))) * F.col("statistic")
    p = F.expr("aggregate(sequence(1, 100), 0D, (s, k) -> s + 2 * power(-1D, k - 1) * exp(-2D * k * k * _z * _z))")
    # Below that the series has not settled and the value is 1 to many digits.
    bound = F.when(F.col("_z") < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
    return best.withColumn("_z", z).withColumn("p_value", bound).drop("_z")
