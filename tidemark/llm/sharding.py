"""Reproducible shards: global row numbers, permuted by a keyed Feistel network with cycle walking.

Rows are numbered 0 .. n-1 by hash bucket and then by their values, so the numbers depend on the rows
alone and not on files, partitions or retries. The Feistel network permutes the next power of four at
or above n; a value outside 0 .. n-1 is permuted again until it falls inside, which makes a permutation
of exactly n numbers. Position p lies in shard ``p % shards`` at slot ``p / shards``: row counts differ
by one at most, slots have no gaps, and both follow from the row number without looking at other rows.

Cases: equal rows are counted before anything is shuffled and get neighbouring row numbers; null values
order first; an empty table gives no rows; every column takes part in the order, so pass narrow rows;
a column named like one of the added ones is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import table

#: Hash buckets for the numbering; each is ordered by itself.
BUCKETS = 4096
ROUNDS = 6
#: Walks after which a value that is still outside is an error; each walk ends with a chance of over 1/4.
WALKS = 200
#: Copies of a row that are written out together.
COPIES = 1000
SHARDS, SEED = 40, 20240229


def number_rows(rows: DataFrame, into: str = "row_number", total: str = "n_rows", bucket: Column | None = None) -> DataFrame:
    """``rows`` with a row number from 0 without gaps, and the number of rows.

    ``bucket`` is a number below BUCKETS that spreads the rows evenly, a hash of all columns by default.
    """
    names = rows.columns
    if {into, total, "_copies", "_bucket", "_before", "_part"} & set(names):
        raise ValueError("a column has the name of one that this adds")
    counted = rows.groupBy(*names).agg(F.count("*").alias("_copies")).withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(BUCKETS)) if bucket is None else bucket)
    sums = counted.groupBy("_bucket").agg(F.sum("_copies").alias("_n"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of BUCKETS rows at most
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = sums.select("_bucket", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(all_rows).alias(total))
    order = Window.partitionBy("_bucket").orderBy(*names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = counted.withColumn(into, F.sum("_copies").over(order) - F.col("_copies")).join(F.broadcast(before), "_bucket").withColumn(into, F.col(into) + F.col("_before"))
    one = first.where(F.col("_copies") <= COPIES).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    parts = first.where(F.col("_copies") > COPIES).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES).cast("long"))))
    many = parts.repartition("_part").withColumn("_part", F.explode(F.sequence(F.col("_part"), F.least(F.col("_part") + COPIES, F.col("_copies")) - 1)))
    return one.union(many).select(*names, (F.col(into) + F.col("_part")).alias(into), total)


def permute(numbered: DataFrame, row: str, total: str, seed: int, into: str = "position") -> DataFrame:
    """``numbered`` with the place of each row number under the keyed permutation of 0 .. total-1."""
    keys = ", ".join(f"{seed + 7919 * r}L" for r in range(ROUNDS))
    half = "cast((length(bin(greatest(`{0}` - 1, 1L))) + 1) / 2 as int)".format(total)
    step = "aggregate(array({keys}), named_struct('l', shiftright({x}, _half), 'r', {x} & _mask), (s, k) -> named_struct('l', s.r, 'r', s.l ^ (xxhash64(s.r, k) & _mask)), s -> shiftleft(s.l, _half) | s.r)"
    wide = numbered.withColumn("_half", F.expr(half)).withColumn("_mask", F.expr("shiftleft(1L, _half) - 1"))
    once = wide.withColumn("_at", F.expr(step.format(keys=keys, x=f"`{row}`")))
    again = step.format(keys=keys, x="a")
    walk = f"case when _at < `{total}` then _at else aggregate(sequence(1, {WALKS}), _at, (a, i) -> case when a < `{total}` then a else {again} end) end"
    inside = F.when(F.col(into) < F.col(total), F.col(into)).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))
    return once.withColumn(into, F.expr(walk)).withColumn(into, inside).drop("_half", "_mask", "_at")


def shard(rows: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``rows`` with row_number, position, shard and slot."""
    if {"position", "shard", "slot"} & set(rows.columns):
        raise ValueError("a column has the name of one that this adds")
    placed = permute(number_rows(rows), "row_number", "n_rows", seed).drop("n_rows")
    return placed.withColumn("shard", F.pmod("position", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"position div {shards}"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law `rows`."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    placed = shard(rows, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")
