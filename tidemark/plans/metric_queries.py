"""Queries for metrics, baselines, folds, checks and keys."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import folders
from tidemark.functions import metrics, models
from tidemark.operators import backtest, grids, pit, runs
from tidemark.plans.pit_queries import _EST_OK, FIRST, estimates, year_grid
from tidemark.plans.views import Views, sql

BY = ["model"]
LEVELS = metrics.LEVELS
CONFIG = backtest.Config(metric="ebit", start_year=1997, end_year=1999, grid="fiscal_year_end")
NAMED = {"RandomWalk": "rw_pred", "Forecast": "prediction"}


def _round(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


def quantiles(v: Views) -> DataFrame:
    """Forecasts with nine quantiles around the prediction."""
    steps = ", ".join(f"{0.8 + 0.4 * t!r}D" for t in LEVELS)
    return v.forecasts().where("prediction is not null").withColumn("quantiles", F.expr(f"transform(array({steps}), x -> prediction * x)"))


def candidate_rows(v: Views) -> DataFrame:
    return backtest.candidates(CONFIG, {"income_statement": v.income(), "securities": v.securities()})


def board(v: Views) -> DataFrame:
    rows = v.forecasts().withColumns({"target_value": F.col("actual"), "naive_baseline": F.col("naive"), "rw_pred": F.col("naive"), "bucket": metrics.horizon_bucket()})
    return _round(metrics.scoreboard(rows.drop("model"), NAMED, ["bucket"]))


def checks(v: Views) -> DataFrame:
    rows = v.forecasts().select(F.col("model").alias("security_id"), "prediction")
    return _round(runs.output_checks(rows, 3, 0.05))


def keys(v: Views) -> DataFrame:
    prints = runs.fingerprints({"income_statement": v.income(), "prices": v.prices()}, v.securities(), "stub")
    return runs.cache_keys(year_grid(v).select(*pit.GRID).distinct(), prints, "cfg", "ebit", list(backtest.CACHED)).select("security_id", "as_of_date", "model_name", "cache_key")


def series(v: Views) -> DataFrame:
    """Series of values by user, in order."""
    rows = v.table("events").groupBy(F.col("user_id").cast("string").alias("id")).agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    return rows.select("id", F.expr("transform(s, x -> x.value)").alias("context"))


QUERIES = {
    "met0_mask": lambda v: metrics.masked(v.forecasts(), BY).groupBy("model").agg(F.count("*").alias("n"), F.round(F.min(F.abs("actual")), 4).alias("least")),
    "met1_mape": lambda v: _round(metrics.mape(v.forecasts(), BY)),
    "met2_median_ape": lambda v: _round(metrics.median_ape(v.forecasts(), BY)),
    "met3_accuracy_within": lambda v: _round(metrics.accuracy_within(v.forecasts(), BY, 10)),
    "met4_directional_accuracy": lambda v: _round(metrics.directional_accuracy(v.forecasts(), BY, "naive")),
    "met5_beat_miss": lambda v: _round(metrics.beat_miss(v.forecasts().withColumn("consensus", F.col("lower") + 3000), BY)),
    "met6_signed_errors": lambda v: _round(metrics.signed_errors(v.forecasts(), BY)),
    "met7_coverage": lambda v: _round(metrics.coverage(v.forecasts(), BY)),
    "met8_smape": lambda v: _round(metrics.smape(v.forecasts(), BY)),
    "met9_pearson": lambda v: _round(metrics.correlation(v.forecasts(), BY)),
    "met9_spearman": lambda v: _round(metrics.correlation(v.forecasts(), BY, "spearman")),
    "met10_mase": lambda v: _round(metrics.mase(v.forecasts(), BY)),
    "met11_picp": lambda v: _round(metrics.picp(v.forecasts(), BY)),
    "met12_crps": lambda v: _round(metrics.crps(quantiles(v), BY), 3),
    "met13_calibration": lambda v: _round(metrics.calibration(quantiles(v), BY)),
    "met14_scoreboard": board,
    "met15_horizon_buckets": lambda v: v.forecasts().groupBy(metrics.horizon_bucket().alias("bucket")).agg(F.count("*").alias("n"), F.min("horizon_days").alias("least"), F.max("horizon_days").alias("most")),
    "met16_two_sample_ks": lambda v: _round(metrics.two_sample_ks(v.forecasts().where("model = 'A'"), v.forecasts().where("model = 'R'"))),
    "met17_lag_pairs": lambda v: lag_pairs(v),
    "met17_change_summary": lambda v: _round(metrics.change_summary(annual_pairs(v))),
    "met18_correlation_matrix": lambda v: _round(metrics.correlation_matrix(v.forecasts(), ["actual", "prediction", "naive"])),
    "mdl1_naive": lambda v: models.with_naive(pit.last_actual(year_grid(v), v.income(), "ebit")),
    "mdl2_ar1_by_fold": lambda v: _round(models.ar1(backtest.roles(candidate_rows(v), grids.folds(v.spark, 1997, 1999)).where("role = 'train'"), ["fold_idx"])),
    "mdl6_winsorised": lambda v: _round(series(v).where("size(context) >= 4").select("id", F.explode(F.expr(models.winsorised("context"))).alias("x")).groupBy("id").agg(F.max("x").alias("most"), F.min("x").alias("least"))),
    "mdl7_quantile_at": lambda v: _round(quantiles(v).select("model", F.explode(F.array(*[F.struct(F.lit(t).alias("level"), models.interpolated("quantiles", t).alias("q")) for t in (0.05, 0.25, 0.5, 0.97)])).alias("x")).groupBy("model", "x.level").agg(F.avg("x.q").alias("q")), 3),
    "jn6_fold_roles": lambda v: backtest.roles(candidate_rows(v), grids.folds(v.spark, 1997, 1999)).groupBy("fold_idx", "role").agg(F.count("*").alias("n"), F.min("as_of_date").alias("first"), F.max("target_accepted_date").alias("last")),
    "bt3_candidates": lambda v: candidate_rows(v),
    "bt3_unresolved": lambda v: backtest.unresolved(CONFIG, {"income_statement": v.income(), "securities": v.securities()}),
    "bt7_consensus_snapshot": lambda v: pit.consensus_pick(v.securities().select("security_id", F.lit(dt.date(2024, 1, 20)).alias("as_of_date")), estimates(v), "eps_diluted"),
    "bt8_cache_keys": keys,
    "bt9_cached_rows": lambda v: cached_rows(v),
    "rs2_horizons": lambda v: _round(backtest.Result(candidate_rows(v)).horizons()),
    "rs2_rows_by_symbol": lambda v: symbol_rows(v),
    "pl2_output_checks": checks,
    "mdl11_forecast_context": lambda v: backtest.contexts(year_grid(v), v.income()).select(*pit.GRID, F.size("context").cast("long").alias("n"), F.expr("get(context, 0)").alias("first"), F.expr("get(context, size(context) - 1)").alias("last")),
    "mdl5_forecasts": lambda v: models.forecasts(backtest.contexts(year_grid(v), v.income()), models.LastValue()).select(*pit.GRID, "forecast"),
    "bt4_backtest": lambda v: _round(backtest.run(v.spark, whole_config(v), v.tables(), models.LastValue()).scoreboard(by_bucket=True)),
    "met1_mape_by_horizon": lambda v: _round(metrics.mape(v.forecasts().withColumn("bucket", metrics.horizon_bucket()), ["model", "bucket"])),
}


def whole_config(v: Views) -> backtest.Config:
    """The backtest over all years of the tables: a year's rows are dated after its end, so the first fold loses none."""
    first, last = v.income().agg(F.coalesce(F.min("fiscal_year"), F.lit(CONFIG.start_year)), F.coalesce(F.max(F.year("accepted_date")), F.lit(CONFIG.end_year))).first()
    return backtest.Config(metric="ebit", start_year=first, end_year=last, grid="fiscal_year_end")


def cached_rows(v: Views) -> DataFrame:
    """The backtest over all years where the cache has every forecast: no fit, and each row as it was kept."""
    config, tables, base = whole_config(v), v.tables(), folders.passing_folder(v.spark, "cached")
    rows = backtest.candidates(config, tables).withColumns({"lgbm_pred": F.col("naive_baseline") + 1, "tirex_pred": F.lit(None).cast("double"), "ly_pred": F.col("naive_baseline"), "ensemble_pred": F.col("naive_baseline") * 2})
    rows.write.parquet(f"{base}/rows")
    runs.fingerprints(tables, tables["securities"], models.LastValue.__name__).write.parquet(f"{base}/prints")
    cache = runs.Cache(v.spark, f"{base}/cache")
    backtest.keep(v.spark.read.parquet(f"{base}/rows"), config, v.spark.read.parquet(f"{base}/prints"), cache)
    result = backtest.run(v.spark, config, tables, models.LastValue(), cache=cache)
    return result.rows.select("fold_idx", "security_id", "as_of_date", "target_fy", "lgbm_pred", F.col("tirex_pred").isNull().alias("no_tirex"), "rw_pred", "sn_pred", "ly_pred", F.col("ar1_pred").isNull().alias("no_ar1"), "ensemble_pred", "ensemble_source")


def symbol_rows(v: Views) -> DataFrame:
    """Candidates and their days ahead by symbol."""
    rows = candidate_rows(v).withColumn("tirex_pred", F.when(F.col("horizon_days") > 200, F.col("naive_baseline")))
    return backtest.Result(rows).by_symbol()


def annual_pairs(v: Views) -> DataFrame:
    return metrics.lagged_pairs(pit.annual_panel(v.income(), v.securities(), "revenue"))


def lag_pairs(v: Views) -> DataFrame:
    """Each security's correlation of a year's value with the year before, with at least four pairs."""
    pairs = annual_pairs(v)
    growth = pairs.groupBy("symbol").agg(F.avg("change").alias("growth"))
    return _round(metrics.lag_correlations(pairs).where("n >= 4").join(growth, "symbol"))


_M = "SELECT * FROM (SELECT *, greatest(1e-3, coalesce(quantile_cont(CASE WHEN abs(actual) > 0 THEN abs(actual) END, 0.05) OVER (PARTITION BY {by}), 1e-3)) AS lim FROM {t} WHERE actual IS NOT NULL AND prediction IS NOT NULL) WHERE abs(actual) >= lim"
_MASK = {"m": _M.format(by="model", t="fc")}
_APE = "abs((actual - prediction) / actual)"
_BUCKET = "CASE WHEN horizon_days >= 0 AND horizon_days < 200 THEN 'short' WHEN horizon_days >= 200 AND horizon_days < 365 THEN 'medium' WHEN horizon_days >= 365 AND horizon_days < 100000 THEN 'long' END"
_Q = "SELECT *, list_transform([" + ", ".join(f"{0.8 + 0.4 * t!r}e0" for t in LEVELS) + "], lambda x: prediction * x) AS q FROM fc WHERE prediction IS NOT NULL"
_CORR = "CASE WHEN count(*) >= 2 AND var_pop({x}) > 0 AND var_pop({y}) > 0 THEN greatest(-1e0, least(1e0, covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})))) END"


def _da(ref: str) -> str:
    return f"avg(CASE WHEN sign(actual - {ref}) = sign(prediction - {ref}) THEN 1e0 ELSE 0e0 END) FILTER (actual <> {ref} AND prediction IS NOT NULL)"


_FOLDS = "SELECT CAST(row_number() OVER (ORDER BY cutoff) - 1 AS INT) AS fold_idx, cutoff, coalesce(lead(cutoff) OVER (ORDER BY cutoff), DATE '2001-01-01') AS window_end, row_number() OVER (ORDER BY cutoff) = 1 AS is_seed FROM (SELECT make_date(y + k, m, d) AS cutoff FROM (SELECT unnest(range(1997, 2000)) AS y), (VALUES (0, 5, 15), (0, 8, 14), (0, 11, 15), (1, 3, 1)) AS x(k, m, d))"
_CAND = {
    "g": "SELECT security_id, symbol, min(accepted_date) AS as_of_date, concat('income_statement.FY.', fiscal_year) AS as_of_source FROM inc JOIN sec USING (security_id) WHERE period = 'FY' GROUP BY security_id, symbol, fiscal_year",
    "f": FIRST.format(m="ebit"),
    "tg": "SELECT g.security_id, g.as_of_date, f.fiscal_year AS target_fy, f.first_accepted AS target_accepted_date, f.value AS target_value FROM (SELECT DISTINCT security_id, as_of_date FROM g) g JOIN f ON f.security_id = g.security_id AND f.first_accepted > g.as_of_date QUALIFY row_number() OVER (PARTITION BY g.security_id, g.as_of_date ORDER BY f.fiscal_year) = 1",
    "nb": "SELECT g.security_id, g.as_of_date, ebit AS naive_baseline FROM (SELECT DISTINCT security_id, as_of_date FROM g) g JOIN inc t ON t.security_id = g.security_id AND t.accepted_date <= g.as_of_date WHERE period = 'FY' AND ebit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g.security_id, g.as_of_date ORDER BY end_date DESC, accepted_date DESC) = 1",
    "cand": "SELECT security_id, as_of_date, symbol, as_of_source, target_fy, target_accepted_date, target_value, naive_baseline, CAST(target_accepted_date - as_of_date AS INT) AS horizon_days FROM g JOIN tg USING (security_id, as_of_date) LEFT JOIN nb USING (security_id, as_of_date)",
    "folds": _FOLDS,
    "roles": "SELECT *, 'train' AS role FROM cand, folds WHERE target_accepted_date < cutoff UNION ALL SELECT *, 'test' AS role FROM cand, folds WHERE as_of_date >= cutoff AND as_of_date < window_end AND NOT is_seed",
}
_YEARS = "(SELECT min(fiscal_year) AS lo, (SELECT max(year(accepted_date)) FROM inc) AS hi FROM inc)"
_ALL = {
    **{k: _CAND[k] for k in ("g", "f", "tg", "nb", "cand")},
    "folds": f"SELECT CAST(row_number() OVER (ORDER BY cutoff) - 1 AS INT) AS fold_idx, cutoff, coalesce(lead(cutoff) OVER (ORDER BY cutoff), make_date(hi + 2, 1, 1)) AS window_end, row_number() OVER (ORDER BY cutoff) = 1 AS is_seed FROM (SELECT make_date(y + k, m, d) AS cutoff, hi FROM (SELECT unnest(range(lo, hi + 1)) AS y, hi FROM {_YEARS}), (VALUES (0, 5, 15), (0, 8, 14), (0, 11, 15), (1, 3, 1)) AS x(k, m, d))",
}
_EPS = "SELECT g.security_id, g.as_of_date, period, end_date, arg_max(eps_diluted, accepted_date) AS eps_diluted FROM (SELECT DISTINCT * FROM grid) g JOIN inc t ON t.security_id = g.security_id AND t.accepted_date <= g.as_of_date GROUP BY g.security_id, g.as_of_date, fiscal_year, period, end_date"
_SCORES = "SELECT model, bucket, {m} FROM {t} GROUP BY ALL"
_TALL = f"SELECT * FROM (SELECT 'RandomWalk' AS model, {_BUCKET} AS bucket, actual, naive, naive AS prediction FROM fc UNION ALL SELECT 'Forecast', {_BUCKET}, actual, naive, prediction FROM fc)"
_KS = "SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT prediction AS v, 1 AS a, 0 AS b FROM fc WHERE model = 'A' UNION ALL SELECT prediction, 0, 1 FROM fc WHERE model = 'R') WHERE v IS NOT NULL GROUP BY v"

SQL = {
    "met0_mask": sql("SELECT model, count(*) AS n, round(min(abs(actual)), 4) AS least FROM m GROUP BY model", "fc", **_MASK),
    "met1_mape": sql(f"SELECT model, round(avg({_APE}), 6) AS mape FROM m GROUP BY model", "fc", **_MASK),
    "met2_median_ape": sql(f"SELECT model, round(median({_APE}), 6) AS median_ape FROM m GROUP BY model", "fc", **_MASK),
    "met3_accuracy_within": sql(f"SELECT model, round(avg(CASE WHEN {_APE} <= 0.1e0 THEN 1e0 ELSE 0e0 END), 6) AS accuracy_within FROM m GROUP BY model", "fc", **_MASK),
    "met4_directional_accuracy": sql(f"SELECT model, round({_da('naive')}, 6) AS directional_accuracy FROM fc GROUP BY model", "fc"),
    "met5_beat_miss": sql(f"SELECT model, round({_da('consensus')}, 6) AS beat_miss_accuracy FROM (SELECT *, lower + 3000 AS consensus FROM fc) GROUP BY model", "fc"),
    "met6_signed_errors": sql("SELECT model, round(avg(e), 6) AS spe_mean, round(median(e), 6) AS spe_median, round(stddev_pop(e), 6) AS spe_std, round(avg(power((e - mu) / sd, 3)), 6) AS spe_skew, round(avg(CASE WHEN e > 0 THEN 1e0 ELSE 0e0 END), 6) AS pct_over, round(avg(CASE WHEN e < 0 THEN 1e0 ELSE 0e0 END), 6) AS pct_under FROM (SELECT model, e, avg(e) OVER (PARTITION BY model) AS mu, stddev_pop(e) OVER (PARTITION BY model) AS sd FROM (SELECT model, (prediction - actual) / abs(actual) AS e FROM m)) GROUP BY model", "fc", **_MASK),
    "met7_coverage": sql("SELECT model, round(count(prediction) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM fc GROUP BY model", "fc"),
    "met8_smape": sql("SELECT model, round(avg(2 * abs(actual - prediction) / (abs(actual) + abs(prediction) + 1e-8)), 6) AS smape FROM fc WHERE prediction IS NOT NULL GROUP BY model", "fc"),
    "met9_pearson": sql(f"SELECT model, round({_CORR.format(x='actual', y='prediction')}, 6) AS correlation FROM fc WHERE prediction IS NOT NULL GROUP BY model", "fc"),
    "met9_spearman": sql(f"SELECT model, round({_CORR.format(x='rx', y='ry')}, 6) AS correlation FROM (SELECT model, rank() OVER (PARTITION BY model ORDER BY actual) + (count(*) OVER (PARTITION BY model, actual) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY model ORDER BY prediction) + (count(*) OVER (PARTITION BY model, prediction) - 1) / 2e0 AS ry FROM fc WHERE prediction IS NOT NULL) GROUP BY model", "fc"),
    "met10_mase": sql("SELECT model, round(avg(abs(actual - prediction)) / avg(abs(actual - naive)), 6) AS mase FROM fc WHERE prediction IS NOT NULL GROUP BY model", "fc"),
    "met11_picp": sql("SELECT model, round(avg(CASE WHEN actual BETWEEN lower AND upper THEN 1e0 ELSE 0e0 END), 6) AS picp FROM fc GROUP BY model", "fc"),
    "met12_crps": sql("SELECT model, round(avg(c), 3) AS crps, round(-avg(c), 3) AS pinball FROM (SELECT model, (" + " + ".join(f"({t}e0 - CASE WHEN actual < q[{i + 1}] THEN 1e0 ELSE 0e0 END) * (q[{i + 1}] - actual)" for i, t in enumerate(LEVELS)) + ") / 9e0 AS c FROM qs) GROUP BY model", "fc", qs=_Q),
    "met13_calibration": sql(" UNION ALL ".join(f"SELECT model, {t}e0 AS level, round(avg(CASE WHEN actual <= q[{i + 1}] THEN 1e0 ELSE 0e0 END), 6) AS observed FROM qs GROUP BY model" for i, t in enumerate(LEVELS)), "fc", qs=_Q),
    "met14_scoreboard": sql(f"SELECT model, bucket, round(mape, 6) AS mape, round(median_ape, 6) AS median_ape, round(w10, 6) AS accuracy_within_10pct, round(w25, 6) AS accuracy_within_25pct, round(da, 6) AS directional_accuracy, round(da, 6) AS beat_miss_accuracy, round(coverage, 6) AS coverage, round(correlation, 6) AS correlation FROM ({_SCORES.format(m=f'avg({_APE}) AS mape, median({_APE}) AS median_ape, avg(CASE WHEN {_APE} <= 0.1e0 THEN 1e0 ELSE 0e0 END) AS w10, avg(CASE WHEN {_APE} <= 0.25e0 THEN 1e0 ELSE 0e0 END) AS w25', t='mk')}) JOIN ({_SCORES.format(m=_da('naive') + ' AS da, count(prediction) / CAST(count(*) AS DOUBLE) AS coverage', t='tall')}) USING (model, bucket) JOIN ({_SCORES.format(m=_CORR.format(x='actual', y='prediction') + ' AS correlation', t='(SELECT * FROM tall WHERE prediction IS NOT NULL)')}) USING (model, bucket)", "fc", tall=_TALL, mk=_M.format(by="model, bucket", t="tall")),
    "met15_horizon_buckets": sql(f"SELECT {_BUCKET} AS bucket, count(*) AS n, min(horizon_days) AS least, max(horizon_days) AS most FROM fc GROUP BY ALL", "fc"),
    "met16_two_sample_ks": sql("SELECT round(statistic, 6) AS statistic, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, round(CASE WHEN z < 0.2 THEN 1e0 ELSE greatest(0e0, least(1e0, list_sum(list_transform(range(1, 101), lambda k: 2e0 * power(-1e0, k - 1) * exp(-2e0 * k * k * z * z))))) END, 6) AS p_value FROM (SELECT *, (sqrt(n * m / CAST(n + m AS DOUBLE)) + 0.12e0 + 0.11e0 / sqrt(n * m / CAST(n + m AS DOUBLE))) * statistic AS z FROM (SELECT max(abs(x - y)) AS statistic, max(n) AS n, max(m) AS m FROM (SELECT sum(a) OVER w / CAST(sum(a) OVER () AS DOUBLE) AS x, sum(b) OVER w / CAST(sum(b) OVER () AS DOUBLE) AS y, sum(a) OVER () AS n, sum(b) OVER () AS m FROM ks WINDOW w AS (ORDER BY v))))", "fc", ks=_KS),
    "mdl5_forecasts": sql("SELECT security_id, as_of_date, CASE WHEN n >= 12 THEN 4 * CASE WHEN mad = 0 THEN last ELSE greatest(med - 5e0 * 1.4826e0 * mad, least(med + 5e0 * 1.4826e0 * mad, last)) END END AS forecast FROM (SELECT security_id, as_of_date, count(*) AS n, any_value(med) AS med, median(abs(eps_diluted - med)) AS mad, arg_max(eps_diluted, ROW(end_date, period)) AS last FROM (SELECT *, median(eps_diluted) OVER (PARTITION BY security_id, as_of_date) AS med FROM st WHERE period LIKE 'Q%' AND eps_diluted IS NOT NULL) GROUP BY ALL)", "inc", "grid", st=_EPS),
    "bt7_consensus_snapshot": sql("SELECT security_id, as_of_date, consensus FROM (SELECT security_id, DATE '2024-01-20' AS as_of_date FROM sec) JOIN e USING (security_id) WHERE pulled_at <= as_of_date + INTERVAL '23:59:59' AND metric = 'eps' AND target_date >= as_of_date QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY target_date, pulled_at DESC) = 1", "sec", "est0", e=_EST_OK),
    "met17_lag_pairs": sql(f"SELECT symbol, round({_CORR.format(x='value', y='lagged')}, 6) AS correlation, count(*) AS n, round(avg((value - lagged) / nullif(abs(lagged), 0)), 6) AS growth FROM (SELECT symbol, value, lag(value) OVER (PARTITION BY symbol ORDER BY fiscal_year) AS lagged FROM f JOIN sec USING (security_id)) WHERE lagged IS NOT NULL GROUP BY symbol HAVING count(*) >= 4", "inc", "sec", f=FIRST.format(m="revenue")),
    "met18_correlation_matrix": sql(" UNION ALL ".join(f"SELECT '{a}' AS one, '{b}' AS other, round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 6) AS correlation FROM fc WHERE prediction IS NOT NULL" for a, b in (("actual", "prediction"), ("actual", "naive"), ("prediction", "naive"))), "fc"),
    "mdl1_naive": sql("SELECT security_id, as_of_date, naive_baseline, naive_baseline AS rw_pred, naive_baseline AS sn_pred, naive_baseline AS ly_pred FROM nb", "inc", "sec", **{k: _CAND[k] for k in ("g", "nb")}),
    "mdl2_ar1_by_fold": sql("SELECT fold_idx, round(CASE WHEN count(*) FILTER (ok) < 5 OR sum(naive_baseline * naive_baseline) FILTER (ok) <= 0 THEN 1e0 ELSE sum(target_value * naive_baseline) FILTER (ok) / sum(naive_baseline * naive_baseline) FILTER (ok) END, 6) AS slope, count(*) FILTER (ok) AS n FROM (SELECT *, naive_baseline IS NOT NULL AND target_value IS NOT NULL AS ok FROM roles WHERE role = 'train') GROUP BY fold_idx", "inc", "sec", **_CAND),
    "mdl6_winsorised": "WITH s AS (SELECT CAST(user_id AS VARCHAR) AS id, value FROM events), m AS (SELECT id, median(value) AS med, count(*) AS n FROM s GROUP BY id), d AS (SELECT s.id, median(abs(value - med)) AS mad FROM s JOIN m USING (id) GROUP BY s.id) SELECT id, round(max(x), 6) AS most, round(min(x), 6) AS least FROM (SELECT id, CASE WHEN mad = 0 THEN value ELSE greatest(med - 5e0 * 1.4826e0 * mad, least(med + 5e0 * 1.4826e0 * mad, value)) END AS x FROM s JOIN m USING (id) JOIN d USING (id) WHERE n >= 4) GROUP BY id",
    "mdl7_quantile_at": sql("SELECT model, 0.05e0 AS level, round(avg(q[1]), 3) AS q FROM qs GROUP BY model UNION ALL SELECT model, 0.25e0, round(avg(q[2] + (q[3] - q[2]) * 0.5e0), 3) FROM qs GROUP BY model UNION ALL SELECT model, 0.5e0, round(avg(q[5]), 3) FROM qs GROUP BY model UNION ALL SELECT model, 0.97e0, round(avg(q[9]), 3) FROM qs GROUP BY model", "fc", qs=_Q),
    "jn6_fold_roles": sql("SELECT fold_idx, role, count(*) AS n, min(as_of_date) AS first, max(target_accepted_date) AS last FROM roles GROUP BY ALL", "inc", "sec", **_CAND),
    "bt3_candidates": sql("SELECT * FROM cand", "inc", "sec", **{k: _CAND[k] for k in ("g", "f", "tg", "nb", "cand")}),
    "bt3_unresolved": sql("SELECT count(*) AS n_grid, count(*) FILTER (target_fy IS NULL) AS n_unresolved, count(*) FILTER (target_fy IS NOT NULL AND naive_baseline IS NULL) AS n_without_baseline FROM g LEFT JOIN tg USING (security_id, as_of_date) LEFT JOIN nb USING (security_id, as_of_date)", "inc", "sec", **{k: _CAND[k] for k in ("g", "f", "tg", "nb")}),
    "bt8_cache_keys": sql("SELECT security_id, as_of_date, model_name, sha256(concat_ws('|', 'v2', 'cfg', fp, security_id, CAST(as_of_date AS VARCHAR), 'ebit', model_name)) AS cache_key FROM (SELECT DISTINCT * FROM grid) JOIN (SELECT security_id, sha256(concat_ws('|', CASE WHEN i.n IS NULL THEN 'income_statement:0' ELSE concat_ws(':', 'income_statement', i.n, CAST(i.u AS VARCHAR), CAST(i.e AS VARCHAR)) END, CASE WHEN p.n IS NULL THEN 'prices:0' ELSE concat_ws(':', 'prices', p.n, CAST(p.u AS VARCHAR)) END, 'stub')) AS fp FROM sec LEFT JOIN (SELECT security_id, count(*) AS n, max(accepted_date) AS u, max(end_date) AS e FROM inc GROUP BY 1) i USING (security_id) LEFT JOIN (SELECT security_id, count(*) AS n, max(date) AS u FROM px GROUP BY 1) p USING (security_id)) USING (security_id), (VALUES ('LightGBM'), ('TiRex'), ('NaiveLastYear'), ('Ensemble')) AS m(model_name)", "inc", "sec", "grid", "px"),
    "bt9_cached_rows": sql("SELECT fold_idx, security_id, as_of_date, target_fy, naive_baseline + 1 AS lgbm_pred, true AS no_tirex, naive_baseline AS rw_pred, naive_baseline AS sn_pred, naive_baseline AS ly_pred, true AS no_ar1, naive_baseline * 2 AS ensemble_pred, 'cache_hit' AS ensemble_source FROM cand, folds WHERE as_of_date >= cutoff AND as_of_date < window_end AND NOT is_seed AND (SELECT count(*) FROM cand c WHERE c.target_accepted_date < folds.cutoff AND c.target_value IS NOT NULL) >= 10", "inc", "sec", **_ALL),
    "rs2_horizons": sql("SELECT count(horizon_days) AS n, min(horizon_days) AS least, round(quantile_cont(horizon_days, 0.5), 6) AS median, round(quantile_cont(horizon_days, 0.75), 6) AS p75, round(quantile_cont(horizon_days, 0.99), 6) AS p99, max(horizon_days) AS most FROM cand", "inc", "sec", **{k: _CAND[k] for k in ("g", "f", "tg", "nb", "cand")}),
    "rs2_rows_by_symbol": sql("SELECT symbol, count(*) AS n_scored, count(*) FILTER (horizon_days > 200 AND naive_baseline IS NOT NULL) AS n_forecast FROM cand GROUP BY symbol", "inc", "sec", **{k: _CAND[k] for k in ("g", "f", "tg", "nb", "cand")}),
    "met17_change_summary": sql(f"SELECT count(*) AS n, round({_CORR.format(x='value', y='lagged')}, 6) AS correlation, round(quantile_cont(change, 0.25), 6) AS p25, round(quantile_cont(change, 0.5), 6) AS p50, round(quantile_cont(change, 0.75), 6) AS p75, round(quantile_cont(abs(change), 0.5), 6) AS median_size FROM (SELECT *, (value - lagged) / nullif(abs(lagged), 0) AS change FROM (SELECT symbol, value, lag(value) OVER (PARTITION BY symbol ORDER BY fiscal_year) AS lagged FROM f JOIN sec USING (security_id)) WHERE lagged IS NOT NULL)", "inc", "sec", f=FIRST.format(m="revenue")),
    "pl2_output_checks": sql("SELECT 'nan_rate' AS \"check\", round(avg(CASE WHEN prediction IS NULL THEN 1e0 ELSE 0e0 END), 6) AS value, 0.05e0 AS \"limit\", avg(CASE WHEN prediction IS NULL THEN 1e0 ELSE 0e0 END) <= 0.05 AS ok FROM fc UNION ALL SELECT 'security_count', count(DISTINCT model), 3e0, count(DISTINCT model) = 3 FROM fc", "fc"),
    "mdl11_forecast_context": sql("SELECT security_id, as_of_date, count(*) AS n, arg_min(eps_diluted, ROW(end_date, period)) AS first, arg_max(eps_diluted, ROW(end_date, period)) AS last FROM (SELECT DISTINCT security_id, as_of_date FROM grid) JOIN (SELECT security_id, as_of_date, period, end_date, eps_diluted FROM st WHERE period LIKE 'Q%' AND eps_diluted IS NOT NULL) USING (security_id, as_of_date) GROUP BY ALL", "inc", "grid", st="SELECT g.security_id, g.as_of_date, period, end_date, arg_max(eps_diluted, accepted_date) AS eps_diluted FROM (SELECT DISTINCT * FROM grid) g JOIN inc t ON t.security_id = g.security_id AND t.accepted_date <= g.as_of_date GROUP BY g.security_id, g.as_of_date, fiscal_year, period, end_date"),
    "met1_mape_by_horizon": sql(f"SELECT model, bucket, round(avg({_APE}), 6) AS mape FROM mk GROUP BY ALL", "fc", tall=f"SELECT model, {_BUCKET} AS bucket, actual, prediction FROM fc", mk=_M.format(by="model, bucket", t="tall")),
}
