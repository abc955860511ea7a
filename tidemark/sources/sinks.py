"""Writers of tables, matrices, predictions and reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import folders
from tidemark.schema import KEYS, TABLES, assert_unique, check_table, empty, no_nan


#: Rows of a report, which is put together on the driver.
MOST_REPORTED = 10_000


class Warehouse:
    """The six tables as Parquet under a path; appends are checked for columns and keys."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self) -> None:
        """Make what is missing; what is there stays."""
        for name in TABLES:
            try:
                self.spark.read.parquet(f"{self.path}/{name}").schema
            except Exception:  # noqa: BLE001  a table that cannot be read is made
                empty(self.spark, name).write.mode("append").parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{check_table(name)}")

    def append(self, name: str, rows: DataFrame) -> int:
        """Append by name: missing columns are null, unknown ones and repeated keys are errors. Returns how many rows came."""
        schema = TABLES[check_table(name)]
        unknown = set(rows.columns) - set(schema.names)
        if unknown:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        shaped = no_nan(rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]))
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"  # computed once, whatever the rows come from
        try:
            shaped.write.parquet(staged)
            ready = self.spark.read.schema(schema).parquet(staged)
            n, keys = ready.count(), KEYS[name]
            if n:
                assert_unique(ready, keys)
                if not ready.join(self.read(name).select(*keys), keys, "left_semi").isEmpty():
                    raise ValueError(f"a key of {name} is there already")
                ready.write.mode("append").parquet(f"{self.path}/{name}")
            return n
        finally:
            folders.remove(self.spark, staged)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write a table anew, from rows that may read it; the old one is whole until the new one takes its place."""
        schema = TABLES[check_table(name)]
        shaped = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])
        shaped.write.mode("overwrite").parquet(f"{self.path}/{name}.new")
        assert_unique(self.spark.read.schema(schema).parquet(f"{self.path}/{name}.new"), KEYS[name])
        folders.swap(self.spark, f"{self.path}/{name}.new", f"{self.path}/{name}")


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Parquet or CSV, by the path's ending."""
    if path.endswith(".parquet"):
        matrix.write.mode("overwrite").parquet(path)
    elif path.endswith(".csv"):
        matrix.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"neither .parquet nor .csv: {path}")


def write_predictions(rows: DataFrame, folder: str, run: str) -> str:
    """A run's predictions in a file set of its own."""
    where = f"{folder.rstrip('/')}/{run}.parquet"
    rows.write.mode("overwrite").parquet(where)
    return where


def write_report(rows: DataFrame, path: str, **more) -> dict:
    """A result of MOST_REPORTED rows at most as JSON, more are an error; returns what was written."""
    few = rows.limit(MOST_REPORTED + 1).collect()
    if len(few) > MOST_REPORTED:
        raise ValueError(f"a report has {MOST_REPORTED} rows at most; write a table instead")
    report = more | {"rows": [r.asDict(recursive=True) for r in few]}
    with open(path, "w") as out:
        json.dump(report, out, indent=1, sort_keys=True, default=str)
    return report


def append_verdict(path: str, name: str, gain: float | None, status: str) -> None:
    """A line of a Markdown table of verdicts."""
    with open(path, "a") as out:
        out.write(f"| {name} | {'-' if gain is None else f'{gain:+.6f}'} | {status} |\n")
