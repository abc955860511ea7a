"""What the corpus operators share: table access, the shared scratch folder and Arrow batch sizes."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 256, 2 << 20
#: Bytes of text that the vectorised scanners look at together.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the named Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once a context: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    where = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark-code.zip"  # the driver serves it from here
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(str(where))
    sc._tidemark_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small (texts may be very long, executors are not large) and ship the code that reads them."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Intermediate tables of one operator run, kept as Parquet in the shared folder.

    Writing cuts lineage: a lost executor costs the tasks it ran, not the steps before. The folder goes when the
    driver's JVM ends; results that are to outlive it must be written elsewhere before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, frame: DataFrame) -> DataFrame:
        """The same rows, read back from a table in the shared folder."""
        self.n += 1
        where = f"{self.path}/{self.n}"
        frame.write.parquet(where)
        if self.n == 1:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        out = self.spark.read.schema(frame.schema).parquet(where)
        out._tidemark_at = where
        return out

    def again(self, frame: DataFrame) -> DataFrame:
        """A table made by :meth:`cut` in any session, read in this one's."""
        return self.spark.read.schema(frame.schema).parquet(frame._tidemark_at)

    def apart(self, quiet: bool) -> Scratch:
        """For ``quiet`` work on few rows: tables read in a session of their own without code generation for whole stages, whose classes would cost more than they save."""
        if not quiet:
            return self
        out = Scratch.__new__(Scratch)
        out.spark, out.path, out.n = self.spark.newSession(), f"{self.path}/{uuid.uuid4().hex}", 0
        for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            out.spark.conf.set(name, self.spark.conf.get(name))
        out.spark.conf.set("spark.sql.codegen.wholeStage", "false")
        return out

    def settle(self) -> None:
        """Let Spark delete the shuffle files of finished steps: it does so once the driver's JVM has collected what named them."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, frame: DataFrame) -> None:
        """Delete a table made by :meth:`cut` that nothing reads any more."""
        where = getattr(frame, "_tidemark_at", None)
        if where:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


    def keep(self, *frames: DataFrame) -> None:
        """Delete all tables of the run but these: what it returns reads no others."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        stay = {f._tidemark_at.rsplit("/", 1)[1] for f in frames}
        for one in files.listStatus(path) if files.exists(path) else []:
            if one.getPath().getName() not in stay:
                files.delete(one.getPath(), True)
        self.settle()


#: Bytes of fixed-width rows up to which a side of a join is broadcast; beyond that the join shuffles.
MOST_BROADCAST = 24 << 20


def held_small(side: DataFrame, width: int, more: str | None = None) -> DataFrame:
    """A side of a join, broadcast if its rows of ``width`` bytes, with ``more`` (SQL for further bytes of a row), are few enough."""
    size = F.count("*") * (width + 16) + (F.coalesce(F.sum(F.expr(more)), F.lit(0)) if more else F.lit(0))
    return F.broadcast(side) if side.agg(size.alias("n")).first().n <= MOST_BROADCAST else side


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``frame`` has."""
    taken = [c.lower() for c in frame.columns]
    lead = "_"
    while any(c.startswith(lead) for c in taken):
        lead += "_"
    return [f"{lead}{n}" for n in names]


def batches_of(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Groups of Arrow batches with about ``most`` bytes of ``column``, each with that column as bytes (null: empty)."""
    held: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        values = batch.column(column).cast(pa.binary()).to_pylist()
        start = 0
        for i, value in enumerate(values):
            size += len(value or b"")
            if size >= most:
                held.append(batch.slice(start, i + 1 - start))
                texts += [x or b"" for x in values[start : i + 1]]
                yield pa.Table.from_batches(held), texts
                held, texts, size, start = [], [], 0, i + 1
        if start < len(values):
            held.append(batch.slice(start))
            texts += [x or b"" for x in values[start:]]
    if held:
        yield pa.Table.from_batches(held), texts


def learn_from(doc_id: str = "doc_id"):
    """Rows whose labels may be learnt from: crc32 of the id as text is not divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 5 != 0


def held_out(doc_id: str = "doc_id"):
    """Rows kept for measuring; a null id counts as held out."""
    return ~learn_from(doc_id)
