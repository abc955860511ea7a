"""The command line, from a warehouse to checked and recorded forecasts."""

import datetime as dt
import json

import pytest
from pytest_help import D
from tidemark import cli
from tidemark.functions import models
from tidemark.operators import features, runs
from tidemark.sources import sinks


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("cli")
    store = sinks.Warehouse(spark, str(base / "warehouse"))
    store.create()
    store.append("securities", spark.createDataFrame([(f"s{i}", f"T{i}", f"{i:010}") for i in range(6)], "security_id string, symbol string, cik string"))
    rows = [(f"s{i}", y, "FY", D(f"{y}-12-31"), D(f"{y + 1}-02-15"), D(f"{y + 1}-02-15"), 100.0 * (i + 1) + y, 10.0 * i + 1, 50.0 + i) for i in range(6) for y in range(2018, 2023)]
    kind = "security_id string, fiscal_year int, period string, end_date date, accepted_date date, filing_date date, revenue double, net_income double, gross_profit double"
    store.append("income_statement", spark.createDataFrame(rows, kind))
    train = spark.createDataFrame([(float(i), float(i % 3), float(i)) for i in range(60)], "gross_margin double, net_margin double, y double")
    models.Tabular(rounds=2).fit(train, ["gross_margin", "net_margin"], "y").save(spark, str(base / "model"))
    return base


def run(spark, home, command, *more):
    return cli.main([command, *map(str, more)], spark)


def panel(home, *symbols):
    return ["--as-of", "2022-06-30", "--feature", "gross_margin", "--feature", "net_margin", "--warehouse", home / "warehouse", *[x for s in symbols for x in ("--symbol", s)]]


def test_a_data_set_and_its_forecast(spark, home, capsys):
    out = home / "set.parquet"
    assert run(spark, home, "build-dataset", *panel(home, "T1", "T4"), "--output", out) == 0
    rows = spark.read.parquet(str(out))
    assert sorted(r.symbol for r in rows.collect()) == ["T1", "T4"] and {"gross_margin", "net_margin"} <= set(rows.columns)
    assert run(spark, home, "forecast", "--model-path", home / "model", "--dataset-path", out, "--output", home / "p") == 0
    where = capsys.readouterr().out.split("wrote ")[-1].split(" (")[0]
    told = spark.read.parquet(where)
    assert told.columns == ["security_id", "symbol", "as_of_date", "metric", "prediction", "model_name", "run_id"] and told.count() == 2
    assert run(spark, home, "quality-check", "--predictions-path", where, "--expected-securities", 2) == 0
    assert run(spark, home, "quality-check", "--predictions-path", where, "--expected-securities", 3) == 1
    with pytest.raises(ValueError, match="lacks features"):
        runs.run_forecast(str(home / "model"), rows.drop("net_margin"), "eps_diluted", str(home / "p"))
    with pytest.raises(FileNotFoundError):
        runs.run_forecast(str(home / "none"), rows, "eps_diluted", str(home / "p"))


def test_the_chain_is_recorded_once_and_can_be_looked_up(spark, home, capsys):
    more = ["--model-path", home / "model", "--output", home / "chain", "--registry", home / "runs"]
    assert run(spark, home, "chain", *panel(home), *more) == 0
    said = capsys.readouterr().out
    record = said.split("run ")[-1].split(" recorded")[0]
    assert "recorded: True" in said and "[PASS] security_count" in said
    assert run(spark, home, "runs-list", "--registry", home / "runs") == 0 and record in capsys.readouterr().out
    assert run(spark, home, "runs-show", record, "--registry", home / "runs") == 0
    assert json.loads(capsys.readouterr().out)["config"]["as_of"] == "2022-06-30"
    assert run(spark, home, "runs-show", "nothing", "--registry", home / "runs") == 1
    assert run(spark, home, "runs-verify", "--registry", home / "runs") == 0
    runs.Runs(spark, str(home / "runs")).record(run_id="odd", mode="adhoc", config_flags_hash="wrong", started_at=dt.datetime(2024, 1, 1).isoformat(), config={"k": 1})
    assert run(spark, home, "runs-verify", "--registry", home / "runs") == 1
    with pytest.raises(SystemExit):
        run(spark, home, "runs-list", "--mode", "other")
    assert run(spark, home, "chain", *panel(home), *more[:4], "--no-registry") == 0


def test_the_coverage_audit_tells_by_its_exit_status(spark, home):
    report = home / "coverage.json"
    assert run(spark, home, "coverage-audit", "--warehouse", home / "warehouse", "--feature", "gross_margin", "--report", report) in (0, 1)
    rows = {r["feature"]: r for r in json.loads(report.read_text())["rows"]}
    assert rows["gross_margin"]["total"] == 30 and rows["gross_margin"]["floor"] == features.BUILTIN["gross_margin"].min_coverage
    assert run(spark, home, "coverage-audit", "--warehouse", home / "warehouse", "--feature", "return_on_equity", "--report", report) == 1
