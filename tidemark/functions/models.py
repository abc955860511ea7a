"""Baselines, blending, quantile helpers and the tabular regressor."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.folders import ship_code
from tidemark.functions.metrics import LEVELS, finite

# Fewest pairs of the autoregression, fewest rows of the blender, its floor, the forecaster's context and horizon.
LEAST_PAIRS, LEAST_BLEND, FLOOR = 5, 3, 0.30
LEAST_CONTEXT, HORIZON, MAD_CAP, MAD_SCALE = 12, 4, 5.0, 1.4826


def ar1(pairs: DataFrame, by: list[str], value: str = "target_value", lagged: str = "naive_baseline") -> DataFrame:
    """The pooled coefficient of a value on its last one, through the origin; 1 with few pairs or nothing to divide by."""
    ok = finite(value) & finite(lagged)
    y, x = F.when(ok, F.col(value)), F.when(ok, F.col(lagged))
    below = F.sum(x * x)
    slope = F.when((F.count(x) < LEAST_PAIRS) | (below <= 0) | below.isNull(), F.lit(1.0)).otherwise(F.sum(y * x) / F.when(below > 0, below))
    return pairs.groupBy(*by).agg(slope.alias("slope"), F.count(x).alias("n"))


def with_naive(rows: DataFrame, naive: str = "naive_baseline") -> DataFrame:
    """The three models that repeat the last actual value: the season of annual figures is one year."""
    return rows.withColumns({"rw_pred": F.col(naive), "sn_pred": F.col(naive), "ly_pred": F.col(naive)})


def project_simplex(v: np.ndarray, budget: float = 1.0) -> np.ndarray:
    """The nearest point with non-negative parts that sum to the budget."""
    if budget <= 0:
        return np.zeros_like(v, dtype=float)
    u = np.sort(v)[::-1]
    over = (np.cumsum(u) - budget) / np.arange(1, len(v) + 1)
    return np.maximum(v - over[np.flatnonzero(u > over)[-1]], 0.0)


def project_floored(v: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """The same with each part at least its floor; floors that sum to more than one are left aside."""
    rest = 1.0 - floor.sum()
    return project_simplex(v) if rest < -1e-9 else floor + project_simplex(v - floor, rest)


class Blender:
    """Weights on the simplex by projected gradient steps on the Gram matrix, so data are only summed."""

    def __init__(self, floor: dict[int, float] | None = None, most: int = 500, tolerance: float = 1e-8):
        self.floor, self.most, self.tolerance = floor or {}, most, tolerance
        self.weights: np.ndarray | None = None

    def fit_gram(self, gram: np.ndarray, xy: np.ndarray, yy: float) -> "Blender":
        k = len(xy)
        low = np.array([self.floor.get(i, 0.0) for i in range(k)])
        w = project_floored(np.full(k, 1.0 / k), low)
        step = 1.0 / max(2.0 * float(np.linalg.norm(gram, 2)), 1e-12)
        loss = lambda w: float(w @ gram @ w - 2 * w @ xy + yy)
        before = loss(w)
        for _ in range(self.most):
            w = project_floored(w - step * 2 * (gram @ w - xy), low)
            now = loss(w)
            if abs(before - now) < self.tolerance:
                break
            before = now
        self.weights = w
        return self

    def fit(self, rows: DataFrame, signals: list[str], actual: str) -> "Blender | None":
        """Fit on the rows where all is finite; None with fewer than LEAST_BLEND."""
        ok = finite(actual)
        for s in signals:
            ok &= finite(s)
        names = [*signals, actual]
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
        sums = rows.where(ok).agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
        if sums["n"] < LEAST_BLEND:
            return None
        whole = np.zeros((len(names), len(names)))
        for i, (a, b) in enumerate(pairs):
            x, y = names.index(a), names.index(b)
            whole[x, y] = whole[y, x] = sums[f"{i}"]
        return self.fit_gram(whole[:-1, :-1], whole[:-1, -1], whole[-1, -1])

    def column(self, signals: list[str]) -> Column:
        out = F.lit(0.0)
        for s, w in zip(signals, self.weights, strict=True):
            out = out + F.col(s) * float(w)
        return out


def blended(signals: list[str], blender: Blender | None) -> tuple[Column, Column]:
    """The ensemble and where it comes from: the blender where all its signals are finite, else the finite signals' mean."""
    known = F.lit(0)
    total = F.lit(0.0)
    for s in signals:
        known = known + finite(s).cast("int")
        total = total + F.when(finite(s), F.col(s)).otherwise(0.0)
    mean = F.when(known > 0, total / known)
    if blender is None:
        return mean, F.when(known > 0, F.lit("mean")).otherwise("none")
    ready = known == len(signals)
    return F.when(ready, blender.column(signals)).otherwise(mean), F.when(ready, F.lit("learned")).when(known > 0, "mean").otherwise("none")


def winsorised(values: str, cap: float = MAD_CAP) -> str:
    """SQL for an array with its values clipped to the median plus or minus so many scaled median deviations."""
    if cap <= 0:
        return values
    median = lambda a: f"(get(array_sort({a}), cast((size({a}) - 1) div 2 as int)) + get(array_sort({a}), cast(size({a}) div 2 as int))) / 2"
    spread = median("transform(vs, x -> abs(x - m))")
    clip = f"transform(array({spread}), d -> case when d = 0 then vs else transform(vs, x -> greatest(m - {cap}D * {MAD_SCALE}D * d, least(m + {cap}D * {MAD_SCALE}D * d, x))) end)[0]"
    return f"transform(array({values}), vs -> case when size(vs) < 4 then vs else transform(array({median('vs')}), m -> {clip})[0] end)[0]"


def monotonic(quantiles: str) -> Column:
    """Quantiles in order."""
    return F.array_sort(quantiles)


def interpolated(quantiles: str, level: float, levels: tuple[float, ...] = LEVELS) -> Column:
    """The value at a level between the known ones; beyond them the outermost."""
    q = [F.col(quantiles)[i] for i in range(len(levels))]
    if level <= levels[0]:
        return q[0]
    if level >= levels[-1]:
        return q[-1]
    i = int(np.searchsorted(levels, level, side="right")) - 1
    share = (level - levels[i]) / (levels[i + 1] - levels[i])
    return q[i] + (q[i + 1] - q[i]) * share


class Backend(Protocol):
    """A zero-shot forecaster: a series and a horizon in, (horizon, 9) quantiles out."""

    def forecast(self, series: np.ndarray, horizon: int) -> np.ndarray: ...


class LastValue:
    """A backend that repeats the last value."""

    def forecast(self, series: np.ndarray, horizon: int) -> np.ndarray:
        return np.full((horizon, len(LEVELS)), float(series[-1]))


def series_key(series: np.ndarray) -> str:
    """The name under which a series' forecast is kept."""
    return hashlib.sha256(np.round(np.asarray(series, float), 6).astype(np.float32).tobytes()).hexdigest()[:16]


class FromFiles:
    """A backend that reads forecasts kept as JSON under their series' key."""

    def __init__(self, folder: str):
        self.folder = folder

    def forecast(self, series: np.ndarray, horizon: int) -> np.ndarray:
        path = Path(self.folder) / f"{series_key(series)}.json"
        if not path.exists():
            raise FileNotFoundError(path)
        out = np.array(json.loads(path.read_text())["quantiles"], float)
        if len(out) < horizon:
            raise ValueError(f"a horizon of {len(out)} is kept, {horizon} is asked for")
        return out[:horizon]


def forecasts(contexts: DataFrame, backend: Backend, horizon: int = HORIZON, context: str = "context", into: str = "forecast") -> DataFrame:
    """``contexts`` with the sum of median forecasts; null with too short a context or where the backend fails."""
    ship_code(contexts.sparkSession)
    ready = contexts.withColumn("_clipped", F.expr(f"case when size({context}) >= {LEAST_CONTEXT} then {winsorised(context)} end"))

    names = contexts.columns

    def one(v) -> float | None:
        if v is None or len(v) == 0:
            return None
        try:
            out = np.sort(np.asarray(backend.forecast(np.asarray(v, float), horizon)), axis=1)
        except Exception:  # noqa: BLE001  a backend's failure is a missing forecast
            return None
        return float(out[:, len(LEVELS) // 2].sum()) if out.shape == (horizon, len(LEVELS)) else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[names].assign(**{into: [one(v) for v in part["_clipped"]]}).astype({into: "float64"})

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in contexts.schema)
    return ready.mapInPandas(run, f"{kind}, `{into}` double").withColumn(into, F.when(~F.isnan(into), F.col(into)))


class Tabular:
    """A boosted-tree regressor over feature columns with nulls: each null is imputed and marked."""

    def __init__(self, rounds: int = 50, depth: int = 5, rate: float = 0.05, seed: int = 42):
        self.settings = {"maxIter": rounds, "maxDepth": depth, "stepSize": rate, "seed": seed}
        self.features: list[str] = []
        self.model = None

    def _stages(self):
        from pyspark.ml.feature import Imputer, VectorAssembler
        from pyspark.ml.regression import GBTRegressor

        filled = [f"{c}__filled" for c in self.features]
        return [Imputer(inputCols=self.features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=[*filled, *[f"{c}__missing" for c in self.features]], outputCol="__x", handleInvalid="keep"), GBTRegressor(featuresCol="__x", labelCol="__y", predictionCol="__p", lossType="absolute", **self.settings)]

    def _marked(self, rows: DataFrame) -> DataFrame:
        missing = set(self.features) - set(rows.columns)
        if missing:
            raise ValueError(f"missing features: {sorted(missing)}")
        return rows.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in self.features})

    def fit(self, rows: DataFrame, features: list[str], target: str) -> "Tabular":
        from pyspark.ml import Pipeline

        known = rows.where(finite(target))
        counts = known.agg(*[F.count(c).alias(c) for c in features]).first()
        self.features = [c for c in features if counts[c]]  # a feature that is never known says nothing
        if not self.features:
            raise ValueError("no feature has a value")
        self.model = Pipeline(stages=self._stages()).fit(self._marked(known).withColumn("__y", F.col(target).cast("double")))
        return self

    def predict(self, rows: DataFrame, into: str = "lgbm_pred") -> DataFrame:
        if self.model is None:
            raise ValueError("not fitted")
        return self.model.transform(self._marked(rows)).select(*rows.columns, F.col("__p").alias(into))

    def importance(self) -> dict[str, float]:
        """How much each feature, with its mark, adds."""
        if self.model is None:
            raise ValueError("not fitted")
        raw = self.model.stages[-1].featureImportances.toArray()
        n = len(self.features)
        return {c: float(raw[i] + raw[n + i]) for i, c in enumerate(self.features)}

    def top(self, k: int) -> list[str]:
        """The k most important features, ties by name."""
        return [c for c, _ in sorted(self.importance().items(), key=lambda x: (-x[1], x[0]))[:k]]

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(json.dumps({"features": self.features, "settings": self.settings}),)], "sidecar string").coalesce(1).write.mode("overwrite").text(f"{path}/sidecar")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Tabular":
        from pyspark.ml import PipelineModel

        try:
            side = json.loads(spark.read.text(f"{path}/sidecar").first().value)
            model = PipelineModel.load(f"{path}/model")
        except Exception as gone:
            raise FileNotFoundError(path) from gone
        out = cls()
        out.features, out.settings, out.model = side["features"], side["settings"], model
        return out
