"""Statement versions from a stream of facts: each batch normalises the securities it touches and appends what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import normalize
from tidemark.schema import FIELDS, VERSION_KEY
from tidemark.sources.sinks import Warehouse

FACTS = "security_id string, concept string, start date, `end` date, filed date, fy int, fp string, form string, value double, unit string"


def fold_in(warehouse: Warehouse, facts_path: str, batch: DataFrame, batch_id: int) -> None:
    """Keep a batch of facts and append the versions that they complete. Late filings are versions like any other; a batch seen again adds nothing."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{facts_path}/batch={batch_id}")
    touched = spark.read.parquet(f"{facts_path}/batch={batch_id}").select("security_id").distinct()
    facts = spark.read.schema(FACTS).parquet(*[f"{facts_path}/batch={i}" for i in range(batch_id + 1)]).join(touched, "security_id", "left_semi").dropDuplicates()
    for name, rows in normalize.normalise(facts).items():
        assert name in FIELDS
        warehouse.append(name, rows.join(warehouse.read(name).select(*VERSION_KEY), VERSION_KEY, "left_anti"))


def start(spark: SparkSession, source: str, warehouse: Warehouse, facts_path: str, checkpoint: str) -> StreamingQuery:
    """Process the Parquet fact files that have come to ``source`` since the last time."""
    stream = spark.readStream.schema(FACTS).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, i: fold_in(warehouse, facts_path, batch, i)).start()
