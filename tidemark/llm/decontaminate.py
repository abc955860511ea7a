"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned and verified.

Words are runs of letters and digits (any character above ASCII counts as a letter), A-Z
lower-cased. A window is ``length`` consecutive words of an item; an item of fewer words, but not
none, is one window. Every word of a document inside any occurrence of a window is hit.

Cases: a null or empty text has no words and no hits; an item without words has no window; repeated
items and items with a null id mark words alike, a null id is not listed; equal item ids count once;
repeated documents are judged each for itself; an empty benchmark hits nothing; further columns of
either table play no part. A document is contaminated if it has hits and ``20 * n_hit >= n_words``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm._shared import Scratch, batches_of, fresh, small_batches, table

#: Words in a window.
WINDOW = 13
#: The columns that a report adds, and their types.
ADDED = ("n_words", "n_hit", "items", "contaminated", "spans")
KINDS = ("long", "long", "array<string>", "boolean", "array<array<long>>")
#: A benchmark of more text than this is not broadcast but joined window by window.
MOST_BROADCAST = 48 << 20


class Grams:
    """The windows of some items: lengths, sorted hashes, and for each hash the items and their words."""

    def __init__(self, items: list[tuple[str | None, bytes]], length: int):
        joined, starts, ends, hashes, first = W.words([x for _, x in items], W.ALNUM)
        self.names = [name for name, _ in items]
        where: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.text = [self.normal(joined, starts, ends, a, b) for a, b in zip(first, first[1:], strict=False)]
        for i, (a, b) in enumerate(zip(first, first[1:], strict=False)):
            if n := min(length, int(b - a)):
                for k, h in enumerate(W.windows(hashes[a:b], n).tolist()):
                    where.setdefault(n, {}).setdefault(h, []).append((i, k))
        self.of = where
        self.sorted = {n: np.sort(np.fromiter(x, np.uint64, len(x))) for n, x in where.items()}
        self.maps = {n: self._map(x) for n, x in self.sorted.items()}

    @staticmethod
    def normal(joined: bytes, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> list[bytes]:
        return [joined[s:e].lower() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]

    @staticmethod
    def _map(hashes: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << max(16, 4 + len(hashes).bit_length()), bool)
        bits[hashes >> np.uint64(64 - (len(bits).bit_length() - 1))] = True
        return bits

    def hits(self, n: int, seen: np.ndarray) -> np.ndarray:
        """Positions whose hash is in the set; the bit map drops almost all others first."""
        bits, known = self.maps[n], self.sorted[n]
        maybe = np.flatnonzero(bits[seen >> np.uint64(64 - (len(bits).bit_length() - 1))])
        at = np.searchsorted(known, seen[maybe])
        return maybe[known[np.minimum(at, len(known) - 1)] == seen[maybe]]


def scan(texts: list[bytes], grams: Grams) -> list[tuple[int, np.ndarray, list[int], np.ndarray, np.ndarray]]:
    """For each text: its word count, the indexes of hit words, the items found, and the words' bounds in bytes."""
    joined, starts, ends, hashes, first = W.words(texts, W.ALNUM)
    begin = np.cumsum([0] + [len(x) + 1 for x in texts])
    out = []
    marks = np.zeros(len(hashes), bool)
    found: dict[int, set[int]] = {}
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    for n in grams.sorted:
        for p in grams.hits(n, W.windows(hashes, n)).tolist():
            if doc[p] != doc[p + n - 1]:
                continue
            said = Grams.normal(joined, starts, ends, p, p + n)
            true = [i for i, k in grams.of[n][int(W.windows(hashes[p : p + n], n)[0])] if grams.text[i][k : k + n] == said]
            if true:
                marks[p : p + n] = True
                found.setdefault(int(doc[p]), set()).update(true)
    for d in range(len(texts)):
        a, b = int(first[d]), int(first[d + 1])
        some = np.flatnonzero(marks[a:b]) if d in found else np.empty(0, np.int64)
        out.append((b - a, some, sorted(found.get(d, ())), starts[a:b] - begin[d], ends[a:b] - begin[d]))
    return out


def names_of(items: list[int], grams: Grams) -> list[str]:
    return sorted({grams.names[i] for i in items if grams.names[i] is not None})


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 1)
    return list(zip(hit[np.r_[0, cut + 1]].tolist(), hit[np.r_[cut, len(hit) - 1]].tolist(), strict=True))


def report(docs: DataFrame, benchmark: DataFrame, text: str = "text", length: int = WINDOW, into: tuple[str, ...] = ADDED) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted item ids found), contaminated, and spans (first and end byte of each hit run).

    ``into`` gives the five columns other names; columns of these names are replaced.
    """
    if text in into:
        raise ValueError("the text cannot be replaced")
    docs = docs.drop(*into)
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("binary").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    extra = ", ".join(f"`{n}` {kind}" for n, kind in zip(into, KINDS, strict=True))
    if size > MOST_BROADCAST:
        return _by_join(docs, items, text, length, into)
    held = spark.sparkContext.broadcast([(r.name, bytes(r.text)) for r in items.toLocalIterator()])
    schema = docs.schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(held.value, length)
        for rows, texts in batches_of(batches, text):
            got = scan(texts, grams)
            n, hit = [x[0] for x in got], [len(x[1]) for x in got]
            added = [pa.array(n, pa.int64()), pa.array(hit, pa.int64())]
            added.append(pa.array([names_of(x[2], grams) for x in got], pa.list_(pa.string())))
            added.append(pa.array([h > 0 and 20 * h >= w for h, w in zip(hit, n, strict=True)], pa.bool_()))
            added.append(pa.array([[[int(x[3][a]), int(x[4][b])] for a, b in runs(x[1])] for x in got], pa.list_(pa.list_(pa.int64()))))
            yield pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in names), *added], names=[*names, *into])

    wide = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.mapInArrow(run, f"{wide}, {extra}")


def _by_join(docs: DataFrame, items: DataFrame, text: str, length: int, into: tuple[str, ...]) -> DataFrame:
    """The same for a benchmark beyond the broadcast bound: windows of both sides meet in an equi-join on their hash."""
    scratch = Scratch(docs.sparkSession, "decontaminate")

    def unroll(column: str, keep: list[str], lengths: list[int] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, texts in batches_of(batches, column, 1 << 16):
                joined, starts, ends, hashes, first = W.words(texts, W.ALNUM)
                for d, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist(), strict=False)):
                    for n in [min(length, b - a)] if lengths is None else [x for x in lengths if x <= b - a]:
                        if n:
                            said = Grams.normal(joined, starts, ends, a, b)
                            h = W.windows(hashes[a:b], n).view(np.int64)
                            cols = [pa.array([rows.column(c)[d].as_py()] * len(h), rows.column(c).type) for c in keep]
                            yield pa.RecordBatch.from_arrays([*cols, pa.array(h), pa.array(range(len(h)), pa.int64()), pa.array([n] * len(h), pa.int64()), pa.array([b" ".join(said[k : k + n]) for k in range(len(h))], pa.binary())], names=[*keep, "h", "k", "n", "said"])

        return run

    grams = scratch.cut(items.mapInArrow(unroll("text", ["name"], None), "name string, h long, k long, n long, said binary").select("name", "h", "n", "said").distinct())
    lengths = [r.n for r in grams.select("n").distinct().collect()]  # at most `length` rows
    digest, hits_, found_ = fresh(docs, "key", "hit", "items")
    sha = F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit(b"")), 256)
    texts = docs.select(sha.alias("_key"), F.col(text).alias("_text")).dropDuplicates(["_key"])
    seen = texts.mapInArrow(unroll("_text", ["_key"], lengths), "_key string, h long, k long, n long, said binary")
    hits = scratch.cut(seen.join(grams, ["h", "n", "said"]).select(F.col("_key").alias(digest), "k", "n", "name"))
    hit = hits.select(digest, F.explode(F.sequence(F.col("k"), F.col("k") + F.col("n") - 1)).alias("w")).distinct().groupBy(digest).agg(F.sort_array(F.collect_list("w")).alias(hits_))
    found = hits.groupBy(digest).agg(F.sort_array(F.collect_set("name")).alias(found_))
    names = docs.columns
    named = docs.withColumn(digest, sha).join(hit.join(found, digest), digest, "left").select(*names, hits_, found_)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in batches_of(batches, text):
            joined, starts, ends, _, first = W.words(texts, W.ALNUM)
            begin = np.cumsum([0] + [len(x) + 1 for x in texts])
            some = [np.array(x or [], np.int64) for x in rows.column(hits_).to_pylist()]
            n = np.diff(first).tolist()
            added = [pa.array(n, pa.int64()), pa.array([len(x) for x in some], pa.int64())]
            added.append(pa.array([x or [] for x in rows.column(found_).to_pylist()], pa.list_(pa.string())))
            added.append(pa.array([len(h) > 0 and 20 * len(h) >= w for h, w in zip(some, n, strict=True)], pa.bool_()))
            added.append(pa.array([[[int(starts[first[d] + a] - begin[d]), int(ends[first[d] + b] - begin[d])] for a, b in runs(h)] for d, h in enumerate(some)], pa.list_(pa.list_(pa.int64()))))
            yield pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in names), *added], names=[*names, *into])

    wide = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return named.mapInArrow(finish, f"{wide}, {', '.join(f'`{n}` {kind}' for n, kind in zip(into, KINDS, strict=True))}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", length: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    names = tuple(fresh(docs, *ADDED))
    return report(docs, benchmark, text, length, names).where(~F.col(names[3])).select(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", length: int = WINDOW) -> DataFrame:
    """All documents, with the hit spans taken out of the text."""
    names, kind = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    into = tuple(fresh(docs, *ADDED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, values = batch.column(into[4]).to_pylist(), batch.column(text).to_pylist()
            for i, some in enumerate(spans):
                for a, b in reversed(some or []):
                    data = values[i].encode()
                    values[i] = (data[:a] + data[b:]).decode()
            cols = [pa.array(values, batch.column(text).type) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return report(docs, benchmark, text, length, into).mapInArrow(run, kind)


def digest(ids: str = "items"):
    return F.sha2(F.array_join(F.col(ids), ",").cast("binary"), 256)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, hit words, items found, their digest, and the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = report(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest().alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS said
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
v AS (SELECT rid, k, n, array_to_string(w[k:k + n - 1], ' ') AS said
      FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT v.rid, v.k, v.n, g.item_id FROM v JOIN g ON v.said = g.said AND v.n = g.n),
m AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(m.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(m.n_hit, 0) > 0 AND 20 * coalesce(m.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN m USING (rid) LEFT JOIN t USING (rid)
"""
