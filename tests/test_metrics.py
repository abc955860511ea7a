"""Metrics against known answers."""

import math

import numpy as np
import pytest
from tidemark.functions import metrics


def frame(spark, rows, schema="actual double, prediction double"):
    return spark.createDataFrame([tuple(map(float, r)) if r[0] is not None else r for r in rows], schema)


def one(df):
    return df.first()


def test_the_mask_drops_near_zero_actuals(spark):
    rows = frame(spark, [(a, a) for a in (100, 200, 300, 0.0005, 400, 500)])
    assert sorted(r.actual for r in metrics.masked(rows, []).collect()) == [100, 200, 300, 400, 500]


def test_percentage_errors(spark):
    rows = frame(spark, [(100, 105), (100, 110), (100, 130), (None, 1.0)])
    assert one(metrics.mape(rows, [])).mape == pytest.approx(0.15)
    assert one(metrics.median_ape(rows, [])).median_ape == pytest.approx(0.10)
    assert one(metrics.accuracy_within(rows, [], 10)).accuracy_within == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        metrics.accuracy_within(rows, [], -1)


def test_direction(spark):
    rows = spark.createDataFrame([(10.0, 12.0, 11.0), (10.0, 8.0, 11.0), (10.0, 10.0, 11.0), (10.0, 9.0, 10.0)], "prev double, actual double, prediction double")
    assert one(metrics.directional_accuracy(rows, [], "prev")).directional_accuracy == pytest.approx(1 / 3)
    assert one(metrics.beat_miss(rows, [], "prev")).beat_miss_accuracy == pytest.approx(1 / 3)


def test_signed_errors(spark):
    e = np.array([0.1, -0.2, 0.3, 0.05])
    got = one(metrics.signed_errors(frame(spark, [(-100, -100 + 100 * x) for x in e]), []))
    z = (e - e.mean()) / e.std()
    assert (got.spe_mean, got.spe_median, got.spe_std, got.spe_skew, got.pct_over, got.pct_under) == pytest.approx((e.mean(), np.median(e), e.std(), (z**3).mean(), 0.75, 0.25))


def test_empty_and_degenerate_groups_are_null(spark):
    none = frame(spark, [])
    assert one(metrics.mape(none, [])).mape is None and one(metrics.smape(none, [])).smape is None and one(metrics.correlation(none, [])).correlation is None
    flat = frame(spark, [(1, 2), (1, 3)])
    assert one(metrics.correlation(flat, [])).correlation is None
    assert one(metrics.coverage(frame(spark, [(1, 2), (1, float("nan"))]), [])).coverage == 0.5


def test_correlations_match_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, 60).astype(float), rng.integers(0, 9, 60).astype(float)
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    rows = frame(spark, list(zip(x, y, strict=True)))
    assert one(metrics.correlation(rows, [])).correlation == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert one(metrics.correlation(rows, [], "spearman")).correlation == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def test_scaled_and_interval_scores(spark):
    rows = spark.createDataFrame([(10.0, 11.0, 8.0, 9.0, 10.0), (20.0, 18.0, 24.0, 21.0, 25.0)], "actual double, prediction double, naive double, lower double, upper double")
    assert one(metrics.mase(rows, [])).mase == pytest.approx(1.5 / 3)
    assert one(metrics.picp(rows, [])).picp == 0.5
    same = spark.createDataFrame([(10.0, 11.0, 10.0)], "actual double, prediction double, naive double")
    assert one(metrics.mase(same, [])).mase is None


def test_crps_keeps_its_sign_and_checks_shapes(spark):
    rows = spark.createDataFrame([(10.0, [8.0, 10.0, 12.0])], "actual double, quantiles array<double>")
    got = one(metrics.crps(rows, [], levels=(0.25, 0.5, 0.75)))
    assert got.crps == pytest.approx(-1 / 3) and got.pinball == pytest.approx(1 / 3)
    with pytest.raises(Exception, match="quantiles"):
        metrics.crps(rows, []).collect()
    assert {r.level: r.observed for r in metrics.calibration(rows, [], levels=(0.25, 0.5, 0.75)).collect()} == {0.25: 0.0, 0.5: 1.0, 0.75: 1.0}


def test_horizon_buckets_are_half_open(spark):
    rows = spark.createDataFrame([(0,), (199,), (200,), (364,), (365,), (-1,)], "horizon_days int").select("horizon_days", metrics.horizon_bucket().alias("b"))
    assert {r.horizon_days: r.b for r in rows.collect()} == {0: "short", 199: "short", 200: "medium", 364: "medium", 365: "long", -1: None}


def test_two_sample_ks(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 300).round(2), rng.normal(0.2, 1, 200).round(2)
    grid = np.unique(np.r_[a, b])
    d = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    make = lambda v: spark.createDataFrame([(float(x),) for x in v], "prediction double")
    got = one(metrics.two_sample_ks(make(a), make(b)))
    assert got.statistic == pytest.approx(d) and (got.n, got.m) == (300, 200) and 0 < got.p_value < 1
    assert one(metrics.two_sample_ks(make(a), make(a))).p_value == pytest.approx(1.0)


def test_scoreboard_has_all_models(spark):
    rows = spark.createDataFrame([(10.0, 9.0, 11.0, 9.0), (20.0, 18.0, None, 18.0)], "target_value double, naive_baseline double, a double, b double")
    got = {r.model: r for r in metrics.scoreboard(rows, {"A": "a", "B": "b"}, []).collect()}
    assert got["A"].coverage == 0.5 and got["B"].directional_accuracy == 0.0 and math.isclose(got["B"].mape, 0.1)


def test_quantile_metrics_leave_out_what_is_not_finite(spark):
    nan, q = float("nan"), [0.5, 1.0, 1.5]
    rows = [(1.0, q), (2.0, q), (nan, q), (None, q), (1.0, [0.5, nan, 1.5]), (1.0, [0.5, float("inf"), 1.5]), (1.0, [None, 1.0, 1.5])]
    frame = spark.createDataFrame(rows, "actual double, quantiles array<double>")
    levels = (0.25, 0.5, 0.75)
    want = np.mean([[(t - (a < x)) * (x - a) for t, x in zip(levels, q, strict=True)] for a in (1.0, 2.0)])
    assert metrics.crps(frame, [], levels=levels).first().crps == pytest.approx(want)
    assert {r.level: r.observed for r in metrics.calibration(frame, [], levels=levels).collect()} == {0.25: 0.0, 0.5: 0.5, 0.75: 0.5}


def test_correlations_of_pairs_and_of_lags(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    x[:, 2] += x[:, 0]
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(1.0, float("nan"), 2.0), (1.0, None, 2.0)], "a double, b double, c double")
    got = {(r.one, r.other): r.correlation for r in metrics.correlation_matrix(rows, ["a", "b", "c"]).collect()}
    c = np.corrcoef(x.T)
    assert got == pytest.approx({("a", "b"): c[0, 1], ("a", "c"): c[0, 2], ("b", "c"): c[1, 2]})
    panel = spark.createDataFrame([("s", 2000 + i, float(v)) for i, v in enumerate([1, 2, 4, -2, 5])] + [("t", 2000, 1.0), ("t", 2001, 3.0)], "symbol string, fiscal_year int, value double")
    pairs = metrics.lagged_pairs(panel)
    assert sorted(r.change for r in pairs.collect()) == pytest.approx([-1.5, 1.0, 1.0, 2.0, 3.5])
    told = {r.symbol: (r.n, r.correlation) for r in metrics.lag_correlations(pairs).collect()}
    assert told["s"] == (4, pytest.approx(np.corrcoef([1, 2, 4, -2], [2, 4, -2, 5])[0, 1])) and told["t"] == (1, None)
    assert metrics.change_summary(pairs).first().p50 == pytest.approx(1.0)
