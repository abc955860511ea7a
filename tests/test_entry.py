"""The entry module and every registered query of the engine against DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def plain(rows: pd.DataFrame) -> list[tuple]:
    def value(v):
        if isinstance(v, float):
            return None if v != v else round(v, 5) + 0.0
        if v is None or v is pd.NaT or v is pd.NA:
            return None
        return str(v)[:19].replace(" 00:00:00", "") if hasattr(v, "year") else v.item() if hasattr(v, "item") else v

    return sorted((tuple(value(v) for v in r) for r in rows[sorted(rows.columns)].itertuples(index=False)), key=str)


def test_the_flagship_query_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_give_what_their_sql_gives(spark, duck, name):
    got, wanted = catalog.queries()[name](spark, SMALL).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    a, b = plain(got), plain(wanted)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, rel=1e-6, abs=1e-4) if all(isinstance(v, (int, float)) for v in x) else [v if not isinstance(v, float) else pytest.approx(v, rel=1e-6, abs=1e-4) for v in x] == list(y)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert catalog.queries()[name](spark, SMALL).columns
