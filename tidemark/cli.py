"""Command line: data sets, forecasts, checks, the chain of the three, run records, coverage, backtests.

``python -m tidemark.cli <command> --help``. Exit status: 0 all well, 1 a check failed or nothing was found, 2 a wrong argument.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import models
from tidemark.operators import backtest, coverage, features, grids, runs
from tidemark.schema import TABLES
from tidemark.sources import sinks
from tidemark.sources.files import of_symbols

MODES = ("adhoc", "backfill")


def _tables(spark: SparkSession, warehouse: str) -> dict[str, DataFrame]:
    store = sinks.Warehouse(spark, warehouse)
    return {name: store.read(name) for name in TABLES}


def _dataset(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    tables = _tables(spark, args.warehouse)
    names = tables["securities"] if not args.symbol else of_symbols(tables["securities"], args.symbol)
    return features.inference_panel(names, tables, args.as_of, args.feature)


def build_dataset(spark: SparkSession, args: argparse.Namespace) -> int:
    sinks.write_matrix(_dataset(spark, args), args.output)
    print(f"wrote {args.output}")
    return 0


def forecast(spark: SparkSession, args: argparse.Namespace) -> int:
    where, run = runs.run_forecast(args.model_path, spark.read.parquet(args.dataset_path), args.metric, args.output)
    print(f"wrote {where} (run_id={run})")
    return 0


def _checked(spark: SparkSession, predictions: str, expected: int | None, most_missing: float, baseline: str | None) -> int:
    rows = spark.read.parquet(predictions)
    checks = runs.output_checks(rows, -1 if expected is None else expected, most_missing, spark.read.parquet(baseline) if baseline else None)
    told = [r for r in checks.collect() if expected is not None or r.check != "security_count"]  # one row a check
    for r in told:
        print(f"[{'PASS' if r.ok else 'FAIL'}] {r.check}: {r.value} against {r.limit}")
    return 0 if all(r.ok for r in told) else 1


def quality_check(spark: SparkSession, args: argparse.Namespace) -> int:
    return _checked(spark, args.predictions_path, args.expected_securities, args.nan_threshold, args.baseline_path)


def chain(spark: SparkSession, args: argparse.Namespace) -> int:
    started = dt.datetime.now(dt.UTC)
    dataset = f"{args.output}/dataset.parquet"
    sinks.write_matrix(_dataset(spark, args), dataset)
    rows = spark.read.parquet(dataset)
    where, run = runs.run_forecast(args.model_path, rows, args.metric, args.output)
    print(f"wrote {where} (run_id={run})")
    n, n_securities = rows.agg(F.count("*"), F.count_distinct("security_id")).first()
    if not args.no_registry:
        config = {"metric": args.metric, "as_of": str(args.as_of), "features": list(args.feature), "model_path": args.model_path, "warehouse": args.warehouse}
        flags = runs.config_hash(config)
        record = runs.run_id("adhoc", flags, str(args.as_of), args.metric, started)
        new = runs.Runs(spark, args.registry).record(run_id=record, mode="adhoc", config_flags_hash=flags, metric=args.metric, n_securities=n_securities, n_rows_scored=n, status="ok", started_at=started.isoformat(), finished_at=dt.datetime.now(dt.UTC).isoformat(), config=config)
        print(f"run {record} recorded: {new}")
    return _checked(spark, where, n_securities, 0.05, None)


def runs_list(spark: SparkSession, args: argparse.Namespace) -> int:
    for r in runs.Runs(spark, args.registry).list(args.mode, args.metric).toLocalIterator():
        print(f"{r.run_id} | {r.mode} | {r.metric} | {r.start_year}-{r.end_year} | {r.n_rows_scored} rows | {r.status}")
    return 0


def runs_show(spark: SparkSession, args: argparse.Namespace) -> int:
    found = runs.Runs(spark, args.registry).get(args.run_id)
    if found is None:
        print(f"no run {args.run_id}", file=sys.stderr)
        return 1
    config = {k: json.loads(v) for k, v in (found.config or {}).items()}
    print(json.dumps(found.asDict() | {"config": config}, indent=2, sort_keys=True, default=str))
    return 0


def runs_verify(spark: SparkSession, args: argparse.Namespace) -> int:
    drifted = runs.Runs(spark, args.registry).drifted()
    for run in drifted:
        print(f"{run}: the configuration no longer has the hash it was recorded under", file=sys.stderr)
    if not drifted:
        print("no run has drifted")
    return 1 if drifted else 0


def coverage_audit(spark: SparkSession, args: argparse.Namespace) -> int:
    """Which features are known less often than they should be, at each fiscal year's first disclosure."""
    tables = _tables(spark, args.warehouse)
    grid = grids.fiscal_year_end(tables["income_statement"], tables["securities"])
    if grid.isEmpty():
        print("no fiscal years in the income statements", file=sys.stderr)
        return 2
    registry = features.BUILTIN.select(args.feature) if args.feature else features.BUILTIN
    report = sinks.write_report(coverage.feature_coverage(features.matrix(grid, tables, registry), registry), args.report)
    below = [r for r in report["rows"] if r["below"]]
    for r in below:
        print(f"{r['feature']}: {r['coverage']} is below {r['floor']}")
    print(f"{len(report['rows'])} features, {len(below)} below their floor; see {args.report}")
    return 1 if below else 0


def scoreboard(spark: SparkSession, args: argparse.Namespace) -> int:
    """A backtest's scoreboard, whole and by horizon, its horizons and its rows by symbol, as a report."""
    config = backtest.Config(metric=args.metric, start_year=args.start_year, end_year=args.end_year, grid=args.grid, features=tuple(args.feature) or backtest.Config.features)
    backend = models.FromFiles(args.forecasts) if args.forecasts else None
    result = backtest.run(spark, config, _tables(spark, args.warehouse), backend, cache=runs.Cache(spark, args.cache) if args.cache else None)
    rows = lambda frame: [r.asDict() for r in frame.collect()]  # noqa: E731  a row a model, bucket or symbol
    more = {"by_bucket": rows(result.scoreboard(by_bucket=True)), "horizons": rows(result.horizons()), "by_symbol": rows(result.by_symbol()), "folds": result.diagnostics}
    sinks.write_report(result.scoreboard(), args.report, **more)
    print(f"wrote {args.report}")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, run, *flags):
        made = commands.add_parser(name)
        made.set_defaults(run=run)
        for flag, how in flags:
            made.add_argument(flag, **how)

    day, needed = dt.date.fromisoformat, {"required": True}
    panel = [("--as-of", needed | {"type": day}), ("--feature", needed | {"action": "append"}), ("--warehouse", needed), ("--symbol", {"action": "append"})]
    metric, registry = ("--metric", {"default": "eps_diluted"}), ("--registry", {"default": "reports/runs"})
    predictions = ("--output", {"default": "reports/predictions"})
    command("build-dataset", build_dataset, *panel, ("--output", {"default": "reports/datasets/inference.parquet"}))
    command("forecast", forecast, ("--model-path", needed), ("--dataset-path", needed), metric, predictions)
    command("quality-check", quality_check, ("--predictions-path", needed), ("--expected-securities", {"type": int}), ("--nan-threshold", {"type": float, "default": 0.05}), ("--baseline-path", {}))
    command("chain", chain, *panel, ("--model-path", needed), metric, predictions, registry, ("--no-registry", {"action": "store_true"}))
    command("runs-list", runs_list, registry, ("--mode", {"choices": MODES}), ("--metric", {}))
    command("runs-show", runs_show, ("run_id", {}), registry)
    command("runs-verify", runs_verify, registry)
    command("coverage-audit", coverage_audit, ("--warehouse", needed), ("--feature", {"action": "append"}), ("--report", {"default": "reports/coverage.json"}))
    command("scoreboard", scoreboard, ("--warehouse", needed), metric, ("--start-year", {"type": int, "default": 2020}), ("--end-year", {"type": int, "default": 2023}), ("--grid", {"default": "filing_dates"}), ("--feature", {"action": "append", "default": []}), ("--forecasts", {}), ("--cache", {}), ("--report", {"default": "reports/scoreboard.json"}))
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(spark or SparkSession.builder.appName("tidemark").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
