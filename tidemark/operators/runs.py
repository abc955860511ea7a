"""Forecast runs: deterministic ids, output checks, an append-only registry and a prediction cache, all as Parquet tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import folders
from tidemark.functions.metrics import two_sample_ks
from tidemark.functions.models import Tabular
from tidemark.sources.sinks import write_predictions

# The name spaces of run ids.
RUN_SPACE = uuid.UUID("c5d8e2f9-7a14-43b6-8c92-9e58a7d3c1f4")
FORECAST_SPACE = uuid.UUID("5f2e8b73-2c91-4a17-9e58-a7d3c1f4b602")
CACHE_VERSION = "v2"

RUNS = "run_id string, mode string, config_flags_hash string, commit_sha string, metric string, start_year int, end_year int, n_securities int, n_rows_scored int, status string, started_at string, finished_at string, config map<string,string>"
CACHE = "cache_key string, prediction double, created_at timestamp_ntz"


def config_hash(config: dict) -> str:
    """SHA-256 of a configuration's canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=True, default=str).encode()).hexdigest()


def run_id(mode: str, flags: str, window: str, metric: str, started: dt.datetime) -> str:
    """The id of a run: the same for the same run begun in the same minute."""
    return str(uuid.uuid5(RUN_SPACE, f"{mode}|{flags}|{window}|{metric}|{started.strftime('%Y-%m-%dT%H:%M')}"))


def forecast_id(model: str, as_of: dt.date, ids: DataFrame, metric: str) -> str:
    """The id of a forecast over a set of securities. The engine sorts their ids, the digest takes them partition by partition."""
    digest, lead = hashlib.sha256(), ""
    for r in ids.select("security_id").where("security_id is not null").orderBy("security_id").toLocalIterator():
        digest.update(f"{lead}{r.security_id}".encode())
        lead = "|"
    return str(uuid.uuid5(FORECAST_SPACE, f"{model}|{as_of}|{digest.hexdigest()[:16]}|{metric}"))


def run_forecast(model_path: str, dataset: DataFrame, metric: str, folder: str, name: str = "LightGBM") -> tuple[str, str]:
    """Load a model, check that the dataset has its features, predict, and write the predictions; their place and the forecast's id."""
    model = Tabular.load(dataset.sparkSession, model_path)
    lacking = sorted(set(model.features) - set(dataset.columns))
    if lacking:
        raise ValueError(f"the dataset lacks features: {lacking}")
    day = dataset.agg(F.min("as_of_date")).first()[0]
    if day is None:
        raise ValueError("the dataset has no rows")
    run = forecast_id(model_path, day, dataset, metric)
    return write_predictions(forecast_rows(model.predict(dataset, "_told"), "_told", metric, name, run), folder, run), run


def forecast_rows(panel: DataFrame, prediction: str, metric: str, model: str, run: str) -> DataFrame:
    """The seven columns of a prediction file."""
    return panel.select("security_id", "symbol", "as_of_date", F.lit(metric).alias("metric"), F.col(prediction).alias("prediction"), F.lit(model).alias("model_name"), F.lit(run).alias("run_id"))


def output_checks(predictions: DataFrame, expected: int, most_missing: float = 0.05, baseline: DataFrame | None = None) -> DataFrame:
    """Rows (check, value, limit, ok): missing forecasts, securities, and drift where there is a baseline of at least five."""
    missing = F.col("prediction").isNull() | F.isnan("prediction")
    counts = predictions.agg(F.avg(missing.cast("double")).alias("nan_rate"), F.count_distinct("security_id").alias("securities"))
    rows = counts.select(F.explode(F.array(F.struct(F.lit("nan_rate").alias("check"), F.col("nan_rate").alias("value"), F.lit(float(most_missing)).alias("limit"), F.coalesce(F.col("nan_rate") <= most_missing, F.lit(False)).alias("ok")), F.struct(F.lit("security_count").alias("check"), F.col("securities").cast("double").alias("value"), F.lit(float(expected)).alias("limit"), (F.col("securities") == expected).alias("ok")))).alias("r")).select("r.*")
    if baseline is None:
        return rows
    drift = two_sample_ks(predictions, baseline).where("n >= 5 and m >= 5")
    return rows.unionByName(drift.select(F.lit("ks_drift").alias("check"), F.col("p_value").alias("value"), F.lit(0.01).alias("limit"), (F.col("p_value") > 0.01).alias("ok")))


class Store:
    """An append-only table under a path, with the version of its schema in a file beside it; a newer one is refused."""

    VERSION = 1

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        kept = folders.read_text(spark, f"{path}/_version")
        if kept is not None and int(kept) > self.VERSION:
            raise RuntimeError(f"{path} has version {kept.strip()}, newer than {self.VERSION}")
        if kept is None:
            self.append(spark.createDataFrame([], schema))
            folders.write_text(spark, f"{path}/_version", str(self.VERSION))

    def append(self, rows: DataFrame) -> None:
        rows.select(*[c.strip().split(" ")[0] for c in self.schema.replace("map<string,string>", "map").split(",")]).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


class Runs(Store):
    """Run records; a run is recorded once."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, RUNS)

    def record(self, **values) -> bool:
        """Whether the run was new."""
        if not self.read().where(F.col("run_id") == values["run_id"]).isEmpty():
            return False
        names = [c.strip().split(" ")[0] for c in RUNS.replace("map<string,string>", "map").split(",")]
        unknown = set(values) - set(names)
        if unknown:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        config = values.get("config")
        kept = values | {"config": None if config is None else {k: json.dumps(v, sort_keys=True, default=str) for k, v in config.items()}}
        self.append(self.spark.createDataFrame([tuple(kept.get(n) for n in names)], RUNS))
        return True

    def list(self, mode: str | None = None, metric: str | None = None) -> DataFrame:
        rows = self.read()
        if mode:
            rows = rows.where(F.col("mode") == mode)
        if metric:
            rows = rows.where(F.col("metric") == metric)
        return rows.orderBy(F.desc("started_at"), "run_id")

    def get(self, run: str):
        return self.read().where(F.col("run_id") == run).first()

    def drifted(self) -> list[str]:
        """Runs whose configuration no longer has the hash under which it was recorded."""
        out = []
        for r in self.read().where("config is not null").select("run_id", "config_flags_hash", "config").toLocalIterator():
            if config_hash({k: json.loads(v) for k, v in r.config.items()}) != r.config_flags_hash:
                out.append(r.run_id)
        return sorted(out)


class Cache(Store):
    """Predictions by key; of entries written twice the last one counts. A kept null is a hit."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, CACHE)

    def put(self, entries: DataFrame) -> None:
        self.append(entries.select("cache_key", "prediction", F.expr("cast(current_timestamp() as timestamp_ntz)").alias("created_at")))

    def look_up(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (cache_key, ...) with hit and prediction."""
        last = self.read().groupBy("cache_key").agg(F.max_by(F.struct("prediction"), "created_at").alias("_p"))
        met = wanted.join(last, "cache_key", "left")
        return met.withColumns({"hit": F.col("_p").isNotNull(), "prediction": F.col("_p.prediction")}).drop("_p")


def fingerprints(tables: dict[str, DataFrame], securities: DataFrame, backend: str = "none") -> DataFrame:
    """(security_id, fingerprint): a digest of how much of each table a security has and how far it reaches."""
    out = securities.select("security_id")
    parts = []
    for name, until in (("income_statement", "accepted_date"), ("balance_sheet", "accepted_date"), ("cashflow", "accepted_date"), ("prices", "date"), ("analyst_estimates", "pulled_at")):
        if name in tables:
            ends = [F.max("end_date").alias("e")] if "end_date" in tables[name].columns else [F.lit(None).cast("date").alias("e")]
            seen = tables[name].groupBy("security_id").agg(F.count("*").alias("n"), F.max(until).alias("u"), *ends)
            text = F.concat_ws(":", F.lit(name), F.col("n"), F.col("u").cast("string"), F.col("e").cast("string"))
            out = out.join(seen.select("security_id", text.alias(name)), "security_id", "left")
            parts.append(F.coalesce(name, F.lit(f"{name}:0")))
    return out.select("security_id", F.sha2(F.concat_ws("|", *parts, F.lit(backend)), 256).alias("fingerprint"))


def cache_keys(rows: DataFrame, prints: DataFrame, flags: str, metric: str, models: list[str]) -> DataFrame:
    """Rows with a cache key for each model."""
    met = rows.join(prints, "security_id").withColumn("model_name", F.explode(F.array(*[F.lit(m) for m in models])))
    text = F.concat_ws("|", F.lit(CACHE_VERSION), F.lit(flags), "fingerprint", "security_id", F.col("as_of_date").cast("string"), F.lit(metric), "model_name")
    return met.withColumn("cache_key", F.sha2(text, 256))
