"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local master may go without and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tidemark-")


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once a context: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    top = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark-code.zip"  # the driver serves it from here
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f"{top.name}/{f.relative_to(top.parent).relative_to(top.name)}")
    sc.addPyFile(str(where))
    sc._tidemark_shipped = True


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def passing_folder(spark: SparkSession, name: str) -> str:
    """A new folder within the shared one that goes when the driver's JVM ends."""
    where = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    path, files = _path(spark, where)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return where


def held(frame: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder once and read from there: what uses them plans them no more."""
    where = f"{passing_folder(frame.sparkSession, 'held')}/{name}"
    frame.write.parquet(where)
    return frame.sparkSession.read.schema(frame.schema).parquet(where)


def exists(spark: SparkSession, where: str) -> bool:
    path, files = _path(spark, where)
    return files.exists(path)


def remove(spark: SparkSession, where: str) -> None:
    path, files = _path(spark, where)
    files.delete(path, True)


def swap(spark: SparkSession, new: str, where: str) -> None:
    """Put ``new`` in the place of ``where``; at each moment one of old and new is whole, the old one as ``where``.old meanwhile."""
    (source, files), (target, _), (old, _) = (_path(spark, x) for x in (new, where, f"{where}.old"))
    files.delete(old, True)
    if files.exists(target) and not files.rename(target, old):
        raise OSError(f"cannot move {where}")
    if not files.rename(source, target):
        raise OSError(f"cannot move {new}")
    files.delete(old, True)


def read_text(spark: SparkSession, where: str) -> str | None:
    """A small file's text, or None without one."""
    path, files = _path(spark, where)
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, where: str, text: str) -> None:
    path, files = _path(spark, where)
    stream = files.create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
