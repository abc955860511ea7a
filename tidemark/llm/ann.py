"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking.

Each tree turns the space by a random rotation and halves it at the median of one rotated axis a level; the
medians come from a bounded sample, every row is put into a leaf of every tree. A query walks all trees
through one priority queue, ordered by how far it lies beyond the thresholds on the way, and is compared with all rows of
the leaves that come up. It stops where the next leaf lies further off than neighbours do: ``reach`` times the
squared distance of its k-th neighbour in the sample, ``reach`` being such that ``TARGET`` of the neighbours within the sample
lie in a leaf that is visited. So the share of leaves follows the data: few for vectors that lie in groups, four of ten and more
for vectors without any structure, for which no leaf is far off (see the README for figures).

Rows of neighbouring leaves form blocks; a query goes to the blocks of its leaves only, and a block that many queries
visit is given out as often as its queries need. Of a block only a query's best few go on; so candidate pairs are never written out.
Distances are exact, in double precision.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part; equal vectors are one index entry with its least ids, and one query; ties go to the smaller id; with
fewer candidates than asked for, all are returned; an empty table gives no rows; null ids take no part; further columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import Scratch, held_small, small_batches, table

TREES, LEAF, TARGET, SEED = 8, 32, 0.95, 20240229
#: Rows that thresholds are fitted on, the fewest of them in a leaf, and how many of them stand for queries when ``reach`` is set.
MOST_FIT, LEAST_FIT, PROBES = 32_768, 4, 256
#: Rows of a block, about, and queries that are compared with them in one task.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 256
K, EVERY = 10, 100


class Forest:
    """Rotations and thresholds: ``axes`` (trees, dimension, depth), ``cuts`` a list by level of (trees, 2**level)."""

    def __init__(self, fit: np.ndarray, rows: int, dimension: int, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.fit, self.reach = fit, 0.0
        most = int(math.log2(max(1, len(fit) // LEAST_FIT))) if len(fit) else 0
        self.depth = max(0, min(most, dimension, round(math.log2(max(1, rows / leaf)))))
        self.axes = np.stack([np.linalg.qr(rng.standard_normal((dimension, dimension)))[0][:, : self.depth] for _ in range(trees)])
        self.cuts = [np.zeros((trees, 1 << level)) for level in range(self.depth)]
        for t in range(trees):
            along, node = fit @ self.axes[t], np.zeros(len(fit), int)
            for level in range(self.depth):
                for k in range(1 << level):
                    here = along[node == k, level]
                    self.cuts[level][t, k] = np.median(here) if len(here) else 0.0
                node = 2 * node + (along[:, level] > self.cuts[level][t, node])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(self.axes), len(x)), np.int64)
        for t, axes in enumerate(self.axes):
            along = x @ axes
            for level in range(self.depth):
                out[t] = 2 * out[t] + (along[:, level] > self.cuts[level][t, out[t]])
        return out

    def beyond(self, q: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """How far a point lies beyond the thresholds on the way to one leaf of each tree: (trees, leaves)."""
        out = np.zeros(leaves.shape)
        for t, axes in enumerate(self.axes):
            along = q @ axes
            for level in range(self.depth):
                node = leaves[t] >> (self.depth - level)
                gap = along[level] - self.cuts[level][t, node]
                out[t] += np.where((gap > 0) != ((leaves[t] >> (self.depth - level - 1)) & 1).astype(bool), gap * gap, 0.0)
        return out

    def calibrate(self, k: int, target: float = TARGET) -> None:
        """Set ``reach`` so that ``target`` of the k nearest rows of the sample lie within it."""
        probes = self.fit[:: max(1, len(self.fit) // PROBES)]
        leaves, ratios = self.leaves(self.fit), []
        for q in probes:
            d = ((self.fit - q) ** 2).sum(1)
            near = np.argsort(d, kind="stable")[: k + 1]
            near = near[d[near] > 0][:k]
            if len(near):
                ratios.append(self.beyond(q, leaves[:, near]).min(0) / d[near[-1]])
        self.reach = float(np.quantile(np.concatenate(ratios), target)) if ratios else 0.0

    def bounds(self, q: np.ndarray, k: int) -> np.ndarray:
        """For each query how far beyond thresholds a leaf may lie to be visited; without k rows in the sample, any."""
        if len(self.fit) <= k + 1:
            return np.full(len(q), np.inf)
        d = (self.fit * self.fit).sum(1)[None] - 2 * q @ self.fit.T + (q * q).sum(1)[:, None]
        d[d < 1e-9] = np.inf  # the query itself, and what equals it
        return self.reach * np.partition(d, k - 1, axis=1)[:, k - 1]

    def search(self, q: np.ndarray, most: float) -> list[tuple[int, int]]:
        """(tree, leaf) of all leaves at most ``most`` beyond the thresholds, nearest first, by one queue over all trees; two a tree at least."""
        trees = len(self.axes)
        along = np.einsum("d,tdk->tk", q, self.axes)
        queue, out = [(0.0, t, 0, 0) for t in range(trees)], []
        while queue:
            far, t, level, node = heapq.heappop(queue)
            if far > most and len(out) >= 2 * trees:
                break
            while level < self.depth:
                beyond = along[t, level] - self.cuts[level][t, node]
                side = int(beyond > 0)
                heapq.heappush(queue, (far + beyond * beyond, t, level + 1, 2 * node + 1 - side))
                node, level = 2 * node + side, level + 1
            out.append((t, node))
        return out


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, v): vectors of finite components that are not all zero, as arrays of double."""
    plain = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    return plain.where(F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dimension)


def nearest_in(ids: np.ndarray, leaf: np.ndarray, x: np.ndarray, q: np.ndarray, visits: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and exact distances of its k nearest rows in the leaves it visits, ties to smaller ids."""
    order = np.argsort(leaf, kind="stable")
    ids, leaf, x = ids[order], leaf[order], x[order]
    names, start = np.unique(leaf, return_index=True)
    bounds = dict(zip(names.tolist(), zip(start.tolist(), np.r_[start[1:], len(leaf)].tolist(), strict=True), strict=True))
    asked: dict[int, list[int]] = {}
    for i, some in enumerate(visits):
        for at in some.tolist():
            if at in bounds:
                asked.setdefault(at, []).append(i)
    size, rough = (x * x).sum(1), np.full((len(q), len(ids)), np.inf)
    for at, who in asked.items():
        a, b = bounds[at]
        rough[who, a:b] = size[a:b] - 2 * q[who] @ x[a:b].T
    out = []
    for i, near in enumerate(rough):
        some = np.flatnonzero(near < np.inf)
        if len(some) > k:
            bound = np.partition(near[some], k - 1)[k - 1]
            some = some[near[some] <= bound + 1e-9 * (1 + abs(bound) + (q[i] * q[i]).sum())]
        exact = np.sqrt(((x[some] - q[i]) ** 2).sum(1))
        best = np.lexsort((ids[some], exact))[:k]
        out.append((ids[some][best], exact[best]))
    return out


def neighbours(vectors: DataFrame, queries, k: int = K, key: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k nearest found. ``queries`` is a condition on the id column ``id``."""
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "neighbours")
    rows = scratch.cut(usable(vectors, key, vector))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    dimension, count = (sizes[0].n, sizes[0].c) if sizes else (1, 0)
    rows = rows.where(F.size("v") == dimension)
    fit = rows.orderBy(F.xxhash64("id"), "id").limit(MOST_FIT).select("v").toArrow().column("v").combine_chunks()
    forest = Forest(_matrix(fit, dimension), count, dimension)
    forest.calibrate(k, target)
    held = spark.sparkContext.broadcast(forest)  # the sample and trees * (dimension * depth + leaves) numbers, bounded by MOST_FIT
    wide = max(0, round(math.log2(max(1, BLOCK_ROWS * (1 << forest.depth) / max(1, count)))))  # bits of a leaf within its block
    # One more than k of each equal vector: a query leaves itself out.
    firsts = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1).drop("n")
    asked = rows.where(queries)
    alike = asked.groupBy("v").agg(F.min("id").alias("id"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = held.value.leaves(_matrix(b.column("v"), dimension))
            for t in range(len(leaf)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(leaf[t] >> wide), pa.array(leaf[t]), b.column("id"), b.column("v")], names=["tree", "block", "leaf", "id", "v"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), dimension)
            for i, (q, most) in enumerate(zip(x, held.value.bounds(x, k), strict=True)):
                by_block: dict[tuple[int, int], list[int]] = {}
                for t, leaf in held.value.search(q, most):
                    by_block.setdefault((t, leaf >> wide), []).append(leaf)
                n = len(by_block)
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in by_block], pa.int32()), pa.array([at for _, at in by_block], pa.int64()), pa.array([b.column("id")[i].as_py()] * n, pa.int64()), b.column("v").take(pa.array([i] * n, pa.int64())), pa.array(list(by_block.values()), pa.list_(pa.int64()))], names=["tree", "block", "id", "v", "leaves"])

    index = scratch.cut(firsts.select("id", "v").mapInArrow(place, "tree int, block long, leaf long, id long, v array<double>"))
    wanted = scratch.cut(alike.select("id", "v").mapInArrow(visits, "tree int, block long, id long, v array<double>, leaves array<long>"))
    asks = scratch.cut(wanted.groupBy("tree", "block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("parts")))
    asks = held_small(asks, 16)
    block = ["tree", "block", "part"]
    left = index.join(asks, ["tree", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = wanted.join(asks, ["tree", "block"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def compare(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, q = (_matrix(t.column("v").combine_chunks(), dimension) for t in (mine, theirs))
        names = np.asarray(theirs.column("id"))
        got = nearest_in(np.asarray(mine.column("id")), np.asarray(mine.column("leaf")), x, q, [np.array(v) for v in theirs.column("leaves").to_pylist()], k + 1)
        return pa.table({"query": pa.array(np.repeat(names, [len(i) for i, _ in got])), "id": pa.array(np.concatenate([i for i, _ in got])), "score": pa.array(np.concatenate([s for _, s in got]))})

    pairs = left.select(*block, "leaf", "id", "v").groupBy(*block).cogroup(right.select(*block, "id", "v", "leaves").groupBy(*block))
    met = pairs.applyInArrow(compare, "query long, id long, score double")
    best = met.groupBy("query", "id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query").orderBy("score", "id")
    top = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    named = asked.join(alike.withColumnRenamed("id", "query"), "v").select(F.col("id").alias("query_id"), "query")
    out = named.join(top, "query").where("id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")))
    return out.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of each row whose vec_id is divisible by 100."""
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)
