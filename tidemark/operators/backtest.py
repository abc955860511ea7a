"""Expanding-window backtest: purged folds, baselines, a regressor and a forecaster, blended out of sample.

Features, targets and baselines of all candidates are computed once; the folds only select rows. They run
one after the other because a fold's blender learns from earlier folds' forecasts whose targets have since
become known. Each fold's rows are written before the next begins.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import folders
from tidemark.functions import models
from tidemark.functions.metrics import finite, horizon_bucket, scoreboard
from tidemark.operators import features, grids, pit, runs

PREDICTIONS = {"AR1": "ar1_pred", "Ensemble": "ensemble_pred", "LightGBM": "lgbm_pred", "NaiveLastYear": "ly_pred", "RandomWalk": "rw_pred", "SeasonalNaive": "sn_pred", "TiRex": "tirex_pred"}
#: The models whose forecasts the cache keeps, and their columns.
CACHED = {"LightGBM": "lgbm_pred", "TiRex": "tirex_pred", "NaiveLastYear": "ly_pred", "Ensemble": "ensemble_pred"}
SIGNALS = ["lgbm_pred", "tirex_pred", "naive_baseline"]


@dataclass(frozen=True)
class Config:
    """What a backtest runs over."""

    metric: str = "eps_diluted"
    start_year: int = 2020
    end_year: int = 2023
    grid: str = "filing_dates"
    features: tuple[str, ...] = ("revenue_ttm", "gross_margin", "net_margin", "return_on_equity")
    least_train: int = 10
    least_meta: int = 8
    feature_cap: int | None = None
    floor: float = 0.0
    rounds: int = 20

    def __post_init__(self):
        pit.check_metric(self.metric)
        if self.start_year > self.end_year:
            raise ValueError("start_year must not be after end_year")
        if self.grid not in grids.STRATEGIES:
            raise ValueError(f"unknown grid: {self.grid!r}")
        if not self.features:
            raise ValueError("features must not be empty")
        features.BUILTIN.select(self.features)
        if self.least_train < 1 or self.least_meta < models.LEAST_BLEND or not 0 <= self.floor <= 1:
            raise ValueError("a limit is out of range")


def candidates(config: Config, tables: dict[str, DataFrame]) -> DataFrame:
    """Every grid row with its target, baseline and horizon; rows whose target never became known are left out."""
    income = tables["income_statement"]
    grid = grids.STRATEGIES[config.grid](income, tables["securities"])
    told = grid.join(pit.next_target(grid, income, config.metric), pit.GRID).join(pit.last_actual(grid, income, config.metric), pit.GRID, "left")
    return told.withColumn("horizon_days", F.datediff("target_accepted_date", "as_of_date"))


def unresolved(config: Config, tables: dict[str, DataFrame]) -> DataFrame:
    """One row: grid rows, those without a target, and those with one but without a baseline."""
    income = tables["income_statement"]
    grid = grids.STRATEGIES[config.grid](income, tables["securities"])
    told = grid.join(pit.next_target(grid, income, config.metric), pit.GRID, "left").join(pit.last_actual(grid, income, config.metric), pit.GRID, "left")
    return told.agg(F.count("*").alias("n_grid"), F.count(F.when(F.col("target_fy").isNull(), 1)).alias("n_unresolved"), F.count(F.when(F.col("target_fy").isNotNull() & F.col("naive_baseline").isNull(), 1)).alias("n_without_baseline"))


def roles(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows by fold as `train` (target known before the cutoff) or `test` (dated in the fold's window). Folds are few and broadcast."""
    train = F.col("target_accepted_date") < F.col("cutoff")
    test = (F.col("as_of_date") >= F.col("cutoff")) & (F.col("as_of_date") < F.col("window_end")) & ~F.col("is_seed")
    met = rows.join(F.broadcast(folds), train | test)
    return met.withColumn("role", F.explode(F.expr("filter(array(case when target_accepted_date < cutoff then 'train' end, case when as_of_date >= cutoff and as_of_date < window_end and not is_seed then 'test' end), x -> x is not null)")))


def contexts(points: DataFrame, income: DataFrame) -> DataFrame:
    """The quarterly per-share series known at each point, oldest first."""
    known = pit.series(points, income).where("period like 'Q%' and eps_diluted is not null")
    ordered = F.sort_array(F.collect_list(F.struct("end_date", "period", "eps_diluted")))
    return known.groupBy(*pit.GRID).agg(F.transform(ordered, lambda r: r.eps_diluted).alias("context"))


@dataclass
class Result:
    rows: DataFrame
    diagnostics: list[dict] = field(default_factory=list)

    def scoreboard(self, by_bucket: bool = False) -> DataFrame:
        """Seven models by eight metrics, by horizon bucket if asked."""
        rows = self.rows.withColumn("bucket", horizon_bucket()) if by_bucket else self.rows
        return scoreboard(rows, PREDICTIONS, ["bucket"] if by_bucket else [])

    def horizons(self) -> DataFrame:
        """One row: number, least, median, 75th and 99th percentile and most of the days ahead."""
        h = F.col("horizon_days")
        return self.rows.agg(F.count(h).alias("n"), F.min(h).alias("least"), F.percentile(h, 0.5).alias("median"), F.percentile(h, 0.75).alias("p75"), F.percentile(h, 0.99).alias("p99"), F.max(h).alias("most"))

    def by_symbol(self) -> DataFrame:
        """(symbol, n_scored, n_forecast): rows and those with a forecast of the zero-shot model."""
        return self.rows.groupBy("symbol").agg(F.count("*").alias("n_scored"), F.count(F.when(finite("tirex_pred"), 1)).alias("n_forecast"))


def keys_of(rows: DataFrame, config: Config, prints: DataFrame) -> DataFrame:
    """A cache key for each point of ``rows`` and each cached model."""
    return runs.cache_keys(pit.keys_of(rows), prints, runs.config_hash(asdict(config)), config.metric, list(CACHED))


def keep(rows: DataFrame, config: Config, prints: DataFrame, cache: runs.Cache) -> None:
    """Put the four models' forecasts of ``rows`` into the cache."""
    told = F.coalesce(*[F.when(F.col("model_name") == m, F.struct(F.col(c).alias("p"))) for m, c in CACHED.items()])
    once = rows.dropDuplicates(pit.GRID)
    cache.put(keys_of(once, config, prints).join(once.select(*pit.GRID, *CACHED.values()), pit.GRID).select("cache_key", told.p.alias("prediction")))


def from_cache(rows: DataFrame, config: Config, prints: DataFrame, cache: runs.Cache) -> tuple[int, int, DataFrame]:
    """How many keys ``rows`` have, how many of them are kept, and the rows with the kept forecasts. The autoregression is not kept."""
    met = cache.look_up(keys_of(rows, config, prints))
    counts = met.agg(F.count("*").alias("n"), F.count(F.when(F.col("hit"), 1)).alias("hits")).first()
    kept = met.groupBy(*pit.GRID).agg(*[F.max(F.when(F.col("model_name") == m, F.col("prediction"))).alias(c) for m, c in CACHED.items()])
    same = F.col("ly_pred")
    out = rows.drop(*CACHED.values(), "naive_baseline").join(kept, pit.GRID)
    return counts.n, counts.hits, out.withColumns({"naive_baseline": same, "rw_pred": same, "sn_pred": same, "ar1_pred": F.lit(None).cast("double"), "ensemble_source": F.lit("cache_hit")})


def run(spark: SparkSession, config: Config, tables: dict[str, DataFrame], backend: models.Backend | None = None, folder: str | None = None, cache: runs.Cache | None = None) -> Result:
    """All folds. ``folder`` keeps the intermediate tables; on a cluster it must be shared (spark.checkpoint.dir by default).

    With a ``cache``, a fold of which it has the forecasts of all rows and models is taken from there whole, without a fit; any
    other is computed whole and written back.
    """
    base = f"{folder}/backtest-{uuid.uuid4().hex}" if folder else folders.passing_folder(spark, "backtest")
    rows = candidates(config, tables)
    wide = features.matrix(rows, tables, features.BUILTIN.select(config.features))
    if backend is not None:
        told = models.forecasts(contexts(rows, tables["income_statement"]), backend, into="tirex_pred").select(*pit.GRID, "tirex_pred")
        wide = wide.join(told, pit.GRID, "left")
    else:
        wide = wide.withColumn("tirex_pred", F.lit(None).cast("double"))
    wide = models.with_naive(wide).withColumn("yf_consensus_snapshot", F.lit(None).cast("double"))
    if "analyst_estimates" in tables:
        pick = pit.consensus_pick(rows, tables["analyst_estimates"], config.metric).withColumnRenamed("consensus", "_c")
        wide = wide.join(pick, pit.GRID, "left").withColumn("yf_consensus_snapshot", F.col("_c")).drop("_c")
    wide.write.parquet(f"{base}/candidates")
    wide = spark.read.parquet(f"{base}/candidates")
    schedule = grids.folds(spark, config.start_year, config.end_year)
    if cache is not None:
        runs.fingerprints(tables, tables["securities"], "none" if backend is None else type(backend).__name__).write.parquet(f"{base}/fingerprints")
        prints = spark.read.parquet(f"{base}/fingerprints")
    slopes = {r.fold_idx: r.slope for r in models.ar1(roles(wide, schedule).where("role = 'train'"), ["fold_idx"]).collect()}  # one row a fold
    out: list[DataFrame] = []
    diagnostics = []
    for fold in schedule.orderBy("fold_idx").collect():
        if fold.is_seed:
            continue
        train = wide.where((F.col("target_accepted_date") < F.lit(fold.cutoff)) & finite("target_value"))
        test = wide.where((F.col("as_of_date") >= F.lit(fold.cutoff)) & (F.col("as_of_date") < F.lit(fold.window_end)))
        n_train, n_test = train.count(), test.count()
        note = {"fold_idx": fold.fold_idx, "cutoff": fold.cutoff, "n_train": n_train, "n_test": n_test, "features": [], "meta": False}
        diagnostics.append(note)
        if n_test == 0 or n_train < config.least_train:
            continue
        if cache is not None:
            note["cache_total"], note["cache_hits"], kept = from_cache(test, config, prints, cache)
            if note["cache_total"] == note["cache_hits"] > 0:
                at = {"fold_idx": F.lit(fold.fold_idx), "cutoff": F.lit(fold.cutoff), "cutoff_label": F.lit(fold.cutoff_label)}
                kept.withColumns(at).write.parquet(f"{base}/fold={fold.fold_idx}")
                note["written"] = True
                out.append(spark.read.parquet(f"{base}/fold={fold.fold_idx}"))
                continue
        try:
            model = models.Tabular(rounds=config.rounds).fit(train, list(config.features), "target_value")
            if config.feature_cap and len(model.features) > config.feature_cap:
                model = models.Tabular(rounds=config.rounds).fit(train, model.top(config.feature_cap), "target_value")
            note["features"] = model.features
            told = model.predict(test)
        except ValueError:
            told = test.withColumn("lgbm_pred", F.lit(None).cast("double"))
        told = told.withColumn("ar1_pred", F.col("naive_baseline") * float(slopes.get(fold.fold_idx, 1.0)))
        blender = None
        if out:
            past = out[0]
            for part in out[1:]:
                past = past.unionByName(part, allowMissingColumns=True)
            known = past.where(F.col("target_accepted_date") < F.lit(fold.cutoff))
            for s in [*SIGNALS, "target_value"]:
                known = known.where(finite(s))
            if known.count() >= config.least_meta:
                blender = models.Blender({2: config.floor}).fit(known, SIGNALS, "target_value")
        note["meta"] = blender is not None
        ensemble, source = models.blended(SIGNALS, blender)
        named = told.withColumns({"ensemble_pred": ensemble, "ensemble_source": source, "fold_idx": F.lit(fold.fold_idx), "cutoff": F.lit(fold.cutoff), "cutoff_label": F.lit(fold.cutoff_label)})
        named.write.parquet(f"{base}/fold={fold.fold_idx}")
        note["written"] = True
        out.append(spark.read.parquet(f"{base}/fold={fold.fold_idx}"))
        if cache is not None:
            keep(out[-1], config, prints, cache)
    whole = out[0] if out else wide.withColumns({c: F.lit(None).cast("double") for c in ("lgbm_pred", "ar1_pred", "ensemble_pred")}).limit(0)
    for part in out[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return Result(whole, diagnostics)


def cluster_gain(off: Result, on: Result) -> float | None:
    """How much an added group of features changes the ensemble's median error; negative is better."""
    one, two = (r.scoreboard().where("model = 'Ensemble'").first() for r in (off, on))
    return None if one is None or two is None or one.median_ape is None or two.median_ape is None else two.median_ape - one.median_ape


def win_gate(off: Result, on: Result, noise: float | None = None) -> tuple[float | None, str]:
    """The gain of an added group of features and its verdict: by twice the noise of the median error, where that is known."""
    gain = cluster_gain(off, on)
    if gain is None:
        return None, "UNDEFINED"
    if noise is None:
        return gain, "DEFERRED"
    return gain, "PASS" if gain < -2 * noise else "FAIL"
