"""Baselines, blending, quantiles, the regressor, the backtest, runs and the cache."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pytest_help import D, grid
from tidemark.functions import models
from tidemark.operators import backtest, grids, pit, runs
from tidemark.plans import metric_queries
from tidemark.plans.views import Views


def test_ar1(spark):
    rows = spark.createDataFrame([(1, 2.0 * x, float(x)) for x in range(1, 7)] + [(2, 5.0, 1.0)] + [(3, 1.0, None)], "fold_idx int, target_value double, naive_baseline double")
    assert {r.fold_idx: (r.slope, r.n) for r in models.ar1(rows, ["fold_idx"]).collect()} == {1: (2.0, 6), 2: (1.0, 1), 3: (1.0, 0)}


def test_simplex_projections():
    assert models.project_simplex(np.array([0.5, 0.5, 0.0])) == pytest.approx([0.5, 0.5, 0.0])
    assert models.project_simplex(np.array([2.0, 0.0])) == pytest.approx([1.0, 0.0])
    assert models.project_simplex(np.array([1.0, 1.0]), 0.0) == pytest.approx([0.0, 0.0])
    assert models.project_floored(np.array([1.0, 0.0, 0.0]), np.array([0.0, 0.0, 0.3])) == pytest.approx([0.7, 0.0, 0.3])
    assert models.project_floored(np.array([1.0, 0.0]), np.array([2.0, 2.0])) == pytest.approx([1.0, 0.0])  # floors that cannot be met are left aside


def test_a_floor_shifts_the_optimum_and_does_not_clip_it(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 0.0, 0.6), (0.0, 1.0, 0.0, 0.4), (0.0, 0.0, 1.0, 0.0)], "a double, b double, c double, y double")
    assert models.Blender({2: 0.30}).fit(rows, ["a", "b", "c"], "y").weights == pytest.approx([0.45, 0.25, 0.30], abs=1e-3)
    assert models.Blender().fit(rows, ["a", "b", "c"], "y").weights == pytest.approx([0.6, 0.4, 0.0], abs=1e-3)
    assert models.Blender().fit(rows.limit(2), ["a", "b", "c"], "y") is None


def test_blend_falls_back_on_the_mean_of_what_is_finite(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    blender = models.Blender()
    blender.weights = np.array([1.0, 0.0, 0.0])
    value, source = models.blended(["a", "b", "c"], blender)
    assert [(r.v, r.s) for r in rows.select(value.alias("v"), source.alias("s")).collect()] == [(1.0, "learned"), (2.0, "mean"), (None, "none")]


def test_winsorising(spark):
    def clipped(v, cap=5.0):
        return spark.createDataFrame([(v,)], "v array<double>").select(F.expr(models.winsorised("v", cap)).alias("w")).first().w

    v = [1.0, 2.0, 3.0, 4.0, 100.0]
    m, mad = 3.0, 1.0
    assert clipped(v) == pytest.approx([1, 2, 3, 4, m + 5 * 1.4826 * mad])
    assert clipped(v, 0) == v and clipped(v[:3]) == v[:3] and clipped([1.0, 1.0, 1.0, 9.0]) == [1.0, 1.0, 1.0, 9.0]


def test_forecasts_need_twelve_values_and_survive_a_failing_backend(spark):
    rows = spark.createDataFrame([([float(x) for x in range(12)],), ([1.0] * 11,)], "context array<double>")
    assert [r.forecast for r in models.forecasts(rows, models.LastValue()).collect()] == [44.0, None]

    class Broken:
        def forecast(self, series, horizon):
            raise RuntimeError

    assert [r.forecast for r in models.forecasts(rows, Broken()).collect()] == [None, None]


def test_forecasts_kept_in_files(tmp_path):
    series = np.arange(12.0)
    (tmp_path / f"{models.series_key(series)}.json").write_text('{"quantiles": [[1,2,3,4,5,6,7,8,9],[1,2,3,4,5,6,7,8,9]]}')
    assert models.FromFiles(str(tmp_path)).forecast(series, 2).shape == (2, 9)
    with pytest.raises(ValueError):
        models.FromFiles(str(tmp_path)).forecast(series, 3)
    with pytest.raises(FileNotFoundError):
        models.FromFiles(str(tmp_path)).forecast(series + 1, 2)


def test_the_regressor_handles_nulls_and_is_kept(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), None if i % 5 == 0 else float(i % 3), None, 3.0 * i) for i in range(60)], "a double, b double, never double, y double")
    model = models.Tabular(rounds=5).fit(rows, ["a", "b", "never"], "y")
    assert model.features == ["a", "b"] and model.top(1) == ["a"]
    told = sorted(r.p for r in model.predict(rows, "p").collect())
    model.save(spark, str(tmp_path / "m"))
    again = models.Tabular.load(spark, str(tmp_path / "m"))
    assert sorted(r.p for r in again.predict(rows, "p").collect()) == told and again.features == model.features
    with pytest.raises(ValueError):
        model.predict(rows.drop("a"))
    with pytest.raises(FileNotFoundError):
        models.Tabular.load(spark, str(tmp_path / "none"))


@pytest.fixture(scope="module")
def world(spark):
    """Thirty securities with seven years of quarters, each filed 40 days after its end."""
    rows = []
    for s in range(30):
        for y in range(2014, 2022):
            total = 0.0
            for q, (m, d) in enumerate(((3, 31), (6, 30), (9, 30), (12, 31))):
                v = 1 + s / 10 + (y - 2014) * 0.2 + q * 0.05
                total += v
                end = dt.date(y, m, d)
                if q < 3:
                    rows.append((f"{s}", y, f"Q{q + 1}", end, end + dt.timedelta(40), end + dt.timedelta(40), v * 10, v * 4, v * 3, v * 2, v))
            rows.append((f"{s}", y, "FY", end, end + dt.timedelta(60), end + dt.timedelta(60), total * 10, total * 4, total * 3, total * 2, total))
    from pytest_help import KEY

    income = spark.createDataFrame(rows, f"{KEY}, revenue double, gross_profit double, ebit double, net_income double, eps_diluted double")
    balance = income.selectExpr("security_id", "fiscal_year", "period", "end_date", "accepted_date", "filing_date", "revenue * 3 as total_assets", "revenue as total_equity")
    names = spark.createDataFrame([(f"{s}", f"T{s}", f"{s:010}") for s in range(30)], "security_id string, symbol string, cik string")
    return {"income_statement": income.cache(), "balance_sheet": balance, "securities": names}


@pytest.fixture(scope="module")
def result(spark, world, tmp_path_factory):
    config = backtest.Config(start_year=2018, end_year=2019, grid="fiscal_year_end", rounds=2, features=("revenue_ttm", "net_margin", "return_on_equity"))
    out = backtest.run(spark, config, world, models.LastValue(), str(tmp_path_factory.mktemp("bt")))
    out.rows.cache()
    return out


def test_training_never_sees_a_target_of_the_future(spark, world):
    config = backtest.Config(start_year=2018, end_year=2019, grid="fiscal_year_end")
    met = backtest.roles(backtest.candidates(config, world), grids.folds(spark, 2018, 2019))
    assert met.where("role = 'train' and target_accepted_date >= cutoff").isEmpty()
    train, test = (met.where(F.col("role") == r).select("fold_idx", "security_id", "as_of_date") for r in ("train", "test"))
    assert train.intersect(test).isEmpty() and not test.isEmpty()


def test_targets_are_disclosed_after_the_date(result, world):
    assert result.rows.where("horizon_days <= 0 or horizon_days <> datediff(target_accepted_date, as_of_date)").isEmpty()
    told = result.rows.alias("r").join(world["income_statement"].alias("i"), F.expr("r.security_id = i.security_id and r.target_fy = i.fiscal_year and i.period = 'FY' and i.eps_diluted is not null and i.accepted_date <= r.as_of_date"))
    assert told.isEmpty()


def test_the_blender_starts_when_forecasts_have_come_true(result):
    scored = [d for d in result.diagnostics if d.get("written")]
    assert scored and not scored[0]["meta"]
    cold = result.rows.where("ensemble_source = 'mean'").select(F.abs(F.col("ensemble_pred") - (F.col("lgbm_pred") + F.col("tirex_pred") + F.col("naive_baseline")) / 3).alias("d")).where("d > 1e-9 and d is not null")
    assert cold.isEmpty()


def test_the_scoreboard_has_seven_models(result):
    rows = {r.model: r for r in result.scoreboard().collect()}
    assert set(rows) == set(backtest.PREDICTIONS) and rows["RandomWalk"].directional_accuracy == 0.0
    assert rows["LightGBM"].coverage == 1.0 and rows["AR1"].mape < rows["RandomWalk"].mape
    assert backtest.cluster_gain(result, result) == 0.0


def test_a_kept_backtest_is_not_computed_again(spark, world, result, tmp_path, monkeypatch):
    config = backtest.Config(start_year=2018, end_year=2019, grid="fiscal_year_end", rounds=2, features=("revenue_ttm", "net_margin", "return_on_equity"))
    cache = runs.Cache(spark, str(tmp_path / "cache"))
    first = backtest.run(spark, config, world, models.LastValue(), str(tmp_path), cache)
    told = lambda r: {(x.fold_idx, x.security_id, x.as_of_date): tuple(None if v is None else round(v, 9) for v in (x.lgbm_pred, x.tirex_pred, x.naive_baseline, x.ensemble_pred)) for x in r.rows.collect()}
    assert told(first) == told(result)
    assert [d["cache_hits"] for d in first.diagnostics if d.get("written")] == [0] * sum(bool(d.get("written")) for d in first.diagnostics)
    fits = []
    fit = models.Tabular.fit
    monkeypatch.setattr(models.Tabular, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    again = backtest.run(spark, config, world, models.LastValue(), str(tmp_path), cache)
    assert not fits and told(again) == told(first)
    assert all(d["cache_hits"] == d["cache_total"] == 4 * d["n_test"] for d in again.diagnostics if d.get("written"))
    assert again.rows.where("ensemble_source <> 'cache_hit' or ar1_pred is not null or not rw_pred <=> naive_baseline").isEmpty()
    other = backtest.Config(**{**backtest.asdict(config), "rounds": 1})
    prints = runs.fingerprints(world, world["securities"], "LastValue")
    n, hits, _ = backtest.from_cache(first.rows.limit(5), other, prints, cache)
    assert (n > 0, hits) == (True, 0)  # another configuration has other keys


def test_gates_horizons_and_symbols(spark, result):
    assert backtest.win_gate(result, result) == (0.0, "DEFERRED") and backtest.win_gate(result, result, 0.01) == (0.0, "FAIL")
    days = sorted(r.horizon_days for r in result.rows.select("horizon_days").collect())
    got = result.horizons().first()
    assert (got.n, got.least, got.most) == (len(days), days[0], days[-1]) and got.median == pytest.approx(np.percentile(days, 50)) and got.p99 == pytest.approx(np.percentile(days, 99))
    assert sum(r.n_scored for r in result.by_symbol().collect()) == len(days)


def test_a_newer_registry_is_refused(spark, tmp_path):
    runs.Runs(spark, str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.parquet"))) == len((runs.Runs(spark, str(tmp_path / "r")), list((tmp_path / "r").glob("*.parquet")))[1])
    (tmp_path / "r" / "_version").write_text("99")
    (tmp_path / "r" / "._version.crc").unlink(missing_ok=True)
    with pytest.raises(RuntimeError, match="version 99"):
        runs.Runs(spark, str(tmp_path / "r"))


def test_configurations_are_checked():
    for bad in ({"metric": "revenue"}, {"start_year": 2024}, {"grid": "daily"}, {"features": ()}, {"features": ("x",)}, {"floor": 2.0}):
        with pytest.raises(ValueError):
            backtest.Config(**bad)


def test_run_ids_and_the_registry(spark, tmp_path):
    assert runs.config_hash({"a": 1, "b": 2}) == runs.config_hash({"b": 2, "a": 1})
    start = dt.datetime(2024, 1, 1, 10, 0, 5)
    flags = runs.config_hash({"k": 2})
    run = runs.run_id("adhoc", flags, "2020-2023", "eps_diluted", start)
    assert run == runs.run_id("adhoc", flags, "2020-2023", "eps_diluted", start.replace(second=50)) != runs.run_id("backfill", flags, "2020-2023", "eps_diluted", start)
    registry = runs.Runs(spark, str(tmp_path / "runs"))
    assert registry.record(run_id=run, mode="adhoc", config_flags_hash=flags, metric="eps_diluted", status="ok", started_at="2024-01-01T10:00", config={"k": 2})
    assert not registry.record(run_id=run, mode="adhoc", config_flags_hash=flags)
    assert registry.record(run_id="x", mode="adhoc", config_flags_hash="wrong", started_at="2024-01-02T10:00", config={"k": 3})
    assert [r.run_id for r in registry.list().collect()] == ["x", run] and registry.get(run).config == {"k": "2"} and registry.drifted() == ["x"]


def test_the_cache_gives_back_nulls_as_hits_and_the_last_entry(spark, tmp_path):
    cache = runs.Cache(spark, str(tmp_path / "cache"))
    cache.put(spark.createDataFrame([("a", 1.0), ("b", None)], "cache_key string, prediction double"))
    cache.put(spark.createDataFrame([("a", 2.0)], "cache_key string, prediction double"))
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "cache_key string")
    assert {r.cache_key: (r.hit, r.prediction) for r in cache.look_up(wanted).collect()} == {"a": (True, 2.0), "b": (True, None), "c": (False, None)}


def test_keys_change_with_the_data(spark, world):
    points = grid(spark, "2019-01-01", security="1")
    key = lambda t: runs.cache_keys(points, runs.fingerprints(t, world["securities"]), "f", "ebit", ["m"]).first().cache_key
    assert key(world) == key(world) != key(world | {"income_statement": world["income_statement"].where("fiscal_year < 2020")})


def test_output_checks(spark):
    good = spark.createDataFrame([(f"{i}", float(i)) for i in range(20)], "security_id string, prediction double")
    got = {r.check: r.ok for r in runs.output_checks(good, 20, baseline=good).collect()}
    assert got == {"nan_rate": True, "security_count": True, "ks_drift": True}
    bad = spark.createDataFrame([("a", None), ("b", 1.0)], "security_id string, prediction double")
    assert {r.check: r.ok for r in runs.output_checks(bad, 3, baseline=good).collect()} == {"nan_rate": False, "security_count": False}


def test_forecast_ids_do_not_depend_on_order(spark):
    a = spark.createDataFrame([("x",), ("y",)], "security_id string")
    b = spark.createDataFrame([("y",), ("x",)], "security_id string")
    assert runs.forecast_id("m", D("2024-01-01"), a, "ebit") == runs.forecast_id("m", D("2024-01-01"), b, "ebit")
    assert pit.check_metric("ebit") == "ebit"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_the_registered_backtest_leaves_no_dated_row_out(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(backtest, "run", lambda spark, config, tables, backend: seen.append((config, tables)) or backtest.Result(spark.createDataFrame([], ", ".join(f"{c} double" for c in [*backtest.PREDICTIONS.values(), "target_value", "naive_baseline", "horizon_days"]))))
    metric_queries.QUERIES["bt4_backtest"](Views(spark, "/root/testdata/sf0.001"))
    config, tables = seen[0]
    default = backtest.Config()
    assert (config.rounds, config.features) == (default.rounds, default.features)
    rows = backtest.candidates(config, tables)
    tested = backtest.roles(rows, grids.folds(spark, config.start_year, config.end_year)).where("role = 'test'")
    assert tested.count() == rows.count() > 0
