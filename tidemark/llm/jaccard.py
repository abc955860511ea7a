"""N-gram Jaccard join: a size-aware join of shingle sets, light sets by subsets, heavy sets by inverted lists.

A document's set holds its distinct ``SHINGLE``-word shingles. Two sets link when 100 times their
intersection is at least ``part`` (85 unless another is named) times their union. Equal sets are one node from the start. Then

* light sets (of at most ``boundary`` shingles) enumerate their subsets of fixed sizes: two sets that
  link share a subset as large as the overlap they need, and there are few of those;
* heavy sets go to inverted lists. A list's entry is not one shingle but a block of them: shingles are
  dealt to m blocks by hash, m exceeding the number d of shingles in which two linked sets of that
  size can differ, so at least one block that is not empty is equal in both. A passage that many
  documents share fills no list, because the other shingles of its blocks differ;
* the boundary is the size at which the two ways cost least together, from the counts of small sets.

Sets of different sizes meet because each set enters the lists of every size class in which it can
have a partner. A set with too many empty blocks for the promise to hold enters a second dealing too,
and after ``DEALINGS`` of them its prefix of least hashes; so no link is missed.

Each set is first compared with the least set it shares a list with. What that leaves unconnected is compared
list by list, long lists in tiles, on parity sketches, at first with the nearest set of another component only: the bits in which two sketches differ are at most
the shingles in which the sets differ, so a pair that is out stays inside the task that looks at it. Only
pairs that pass go on to the comparison of whole sets.

Cases: a null or empty text, or one without words, has an empty set, links with nothing and is its own
component; fewer words than a shingle count as one shingle; repeated rows share a set; a null doc_id is
passed over when a component is named, unless it has no other; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm._shared import Scratch, batches_of, fresh, held_small, small_batches, table
from tidemark.llm.bpe import fields
from tidemark.llm.components import components

SHINGLE, PART, WHOLE = 4, 85, 100
#: A size class reaches from lo to STRETCH times lo.
STRETCH = 1.5
DEALINGS = 4
#: Sizes up to which the boundary may lie, and the cost of an inverted-list entry against a subset.
MOST_LIGHT, ENTRY_COST = 32, 2.0
#: Rows of a side that is broadcast; beyond that the join shuffles.
MOST_BROADCAST, MOST_LISTS = 500_000, 2_000_000
#: Members of a list that are compared in one task with as many others.
TILE = 4096
#: Rounds in which an open set tries its nearest other component before all pairs are tried.
NEAREST = 3
U = np.uint64
_ONE, _TWO = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order."""
    _, _, _, hashes, first = W.words(texts, W.SOLID)
    whole = W.windows(hashes, shingle)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        n = b - a
        out.append(np.empty(0, U) if n == 0 else W.windows(hashes[a:b], n) if n < shingle else np.unique(whole[a : b - shingle + 1]))
    return out


def fingerprint(items: np.ndarray, salt: np.uint64) -> int:
    """A 64-bit name of a set, as a signed number."""
    with np.errstate(over="ignore"):
        return int(W.mix(np.array([W.mix(items ^ salt).sum(dtype=U) + U(len(items))]))[:1].view(np.int64)[0])


def least_overlap(a: int, b: int, part: int = PART) -> int:
    """The smallest intersection with which sets of these sizes link."""
    return -(-part * (a + b) // (part + WHOLE))


def partners(size: int, part: int = PART) -> tuple[int, int]:
    """The smallest and the largest size of a set that can link with one of this size."""
    return -(-part * size // WHOLE), WHOLE * size // part


def subset_sizes(size: int, part: int = PART) -> list[int]:
    """Overlaps that some partner of a set of this size needs."""
    lo, hi = partners(size, part)
    return sorted({least_overlap(size, x, part) for x in range(lo, hi + 1)} & set(range(size + 1)))


def subset_cost(size: int, part: int = PART) -> int:
    return sum(comb(size, c) for c in subset_sizes(size, part))


def blocks_for(least: int, d: int) -> int:
    """Blocks m such that of ``least`` shingles dealt to them more than d blocks get one, but for a chance of two standard deviations."""
    m = d + 1
    while m < 4 * (d + 1):
        c = least / m
        empty, spread = m * exp(-c), sqrt(max(0.0, m * (exp(-c) - (1 + c) * exp(-2 * c))))
        if m - empty - 2 * spread >= d + 1:
            break
        m += 1 + m // 64
    return m


def classes_from(boundary: int, largest: int, part: int = PART) -> list[tuple[int, int, int, int]]:
    """Size classes above the boundary: lo, hi, blocks m, and how many blocks may be empty."""
    out, lo = [], boundary + 1
    while lo <= largest:
        hi = max(lo, int(lo * STRETCH))
        d = (WHOLE - part) * 2 * hi // (WHOLE + part)
        m = blocks_for(-(-part * lo // WHOLE), d)
        out.append((lo, hi, m, m - d - 1))
        lo = hi + 1
    return out


def entry_cost(size: int, part: int = PART) -> float:
    return sum(ENTRY_COST * m for lo, hi, m, _ in classes_from(size - 1, size * 2, part) if part * lo <= WHOLE * size and size <= hi)


def choose_boundary(counts: dict[int, int], part: int = PART) -> int:
    """The size up to which subsets are enumerated, from the counts of sets of the sizes 1 to MOST_LIGHT."""
    costs = [sum(n * (subset_cost(s, part) if s <= x else entry_cost(s, part)) for s, n in counts.items()) for x in range(1, MOST_LIGHT + 1)]
    return 1 + int(np.argmin(costs))


def keys_of(items: np.ndarray, boundary: int, classes: list[tuple[int, int, int, int]], part: int = PART) -> np.ndarray:
    """The keys under which a set meets its partners: hashes of subsets, blocks, or shingles."""
    n, out = len(items), []
    with np.errstate(over="ignore"):
        if 0 < n <= boundary:
            x = W.mix(items ^ _ONE)
            total = x.sum(dtype=U)
            for c in subset_sizes(n, part):
                left = [U(0)] if c == n else [x[list(k)].sum(dtype=U) for k in combinations(range(n), n - c)]
                out.append(W.mix(total - np.array(left, U) + U(c) * _TWO))
        for j, (lo, hi, m, spare) in enumerate(classes):
            if part * lo > WHOLE * n or n > hi:
                continue
            for deal in range(DEALINGS):
                salt = U((j * DEALINGS + deal + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
                x = np.sort(W.mix(items ^ salt))
                block = ((x >> U(32)) * U(m)) >> U(32)
                at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                out.append(W.mix(np.add.reduceat(x, at) + (block[at] + U(1)) * _ONE + salt))
                if m - len(at) <= spare:
                    break
            else:
                out.append(W.mix(np.sort(items)[: n - -(-part * n // WHOLE) + 1] + U(j + 1) * _TWO))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def _by_set(texts: DataFrame, made, kind: str, shingle: int) -> DataFrame:
    """Rows that ``made`` gives for each different set of a task; sets seen lately are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, data in batches_of(batches, "_text"):
            new = []
            for items in shingle_sets(data, shingle):
                if len(items) and (name := fingerprint(items, _ONE)) not in seen:
                    seen.add(name)
                    new.append((name, items))
            if len(seen) > 1_000_000:  # copies further apart are only made twice
                seen.clear()
            if new:
                yield made(new)

    return texts.mapInArrow(run, kind)


def _small(side: DataFrame, most: int) -> DataFrame:
    """A side of a join, broadcast if it has no more rows than ``most``."""
    return F.broadcast(side) if side.count() <= most else side


def _linked(batches: Iterator[pa.RecordBatch], part: int = PART) -> Iterator[pa.RecordBatch]:
    """The pairs whose whole sets link."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, U), np.frombuffer(y, U)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(WHOLE * both >= part * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def sketch(items: np.ndarray) -> np.ndarray:
    """A parity sketch: bit h is set if an odd number of shingles hash to h. It has two to four bits a shingle, 256 at least."""
    words = 1 << max(2, (2 * len(items) - 1).bit_length() - 6)
    odd = np.bincount((W.mix(items ^ _TWO) & U(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(U)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set with fewer bits."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, U) for x in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, sets), pa.int64()), pa.array([sketch(x).tobytes() for x in sets], pa.binary())], names=["id", "n", "sketch"])


def may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, part: int = PART) -> np.ndarray:
    """Whether sets of n and m shingles that differ in at least ``apart`` can link."""
    both = -(-part * (n + m) // (part + WHOLE))
    return (WHOLE * np.minimum(n, m) >= part * np.maximum(n, m)) & (apart <= n + m - 2 * both)


def _passing(batches: Iterator[pa.RecordBatch], part: int = PART) -> Iterator[pa.RecordBatch]:
    """The pairs whose sizes and sketches let them link."""
    for batch in batches:
        apart = []
        for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True):
            x, y = np.frombuffer(x, U), np.frombuffer(y, U)
            least = min(len(x), len(y))
            apart.append(int(np.bitwise_count(fold(x, least) ^ fold(y, least)).sum()))
        ok = may_link(np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b")), np.array(apart, np.int64), part)
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _tiled(batches: Iterator[pa.RecordBatch], nearest: bool, part: int = PART) -> Iterator[pa.RecordBatch]:
    """The pairs of a tile that are in different components and may link; rows come sorted by tile.

    ``nearest``: of each member only the pair whose sketches differ least.
    """
    held: list[pa.RecordBatch] = []

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, i, j, p, ids, root, n = (np.asarray(rows.column(c)) for c in ("key", "i", "j", "p", "id", "root", "n"))
        bits = [np.frombuffer(x, U) for x in rows.column("sketch").to_pylist()]
        at = np.flatnonzero(np.r_[True, (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0), True])
        a, b = [], []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            words = min(len(x) for x in bits[lo:hi])
            m = np.stack([fold(x, words) for x in bits[lo:hi]])
            here = slice(lo, hi)
            step = max(1, (1 << 19) // (words * (hi - lo)))
            for s in range(0, hi - lo, step):
                e = slice(lo + s, min(hi, lo + s + step))
                apart = np.bitwise_count(m[s : s + step, None, :] ^ m[None]).sum(2, dtype=np.int64)
                ok = may_link(n[e][:, None], n[here][None], apart, part) & (root[e][:, None] != root[here][None])
                if i[lo] != j[lo]:
                    ok &= p[e][:, None] != p[here][None]
                if nearest:
                    x = np.flatnonzero(ok.any(1))
                    y = np.where(ok, apart, np.iinfo(np.int64).max)[x].argmin(1)
                else:
                    x, y = np.nonzero(ok & (ids[e][:, None] < ids[here][None]))
                a.append(np.minimum(ids[e][x], ids[here][y]))
                b.append(np.maximum(ids[e][x], ids[here][y]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in batches:
        key, i, j = (np.asarray(batch.column(c)) for c in ("key", "i", "j"))
        ends = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))
        if len(ends) and sum(x.num_rows for x in held) + batch.num_rows >= 2048:
            cut = int(ends[-1]) + 1  # a tile that begins behind it may go on in the next batch
            yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held, batch = [], batch.slice(cut)
        if batch.num_rows:
            held.append(batch)
    if held:
        yield from work(pa.Table.from_batches(held))


def classes_of(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, part: int = PART, scratch: Scratch | None = None) -> DataFrame:
    """Rows (key, n_shingles, set_id, component_id): set_id is the same for equal sets, null for an empty one."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "jaccard")
    texts = docs.select(F.col(text).alias("_text"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data in batches_of(batches, "_text"):
            sets = shingle_sets(data, shingle)
            one, two = ([fingerprint(x, salt) if len(x) else None for x in sets] for salt in (_ONE, _TWO))
            yield pa.RecordBatch.from_arrays([rows.column(key).combine_chunks(), pa.array(map(len, sets), pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=[key, "n_shingles", "set_id", "other"])

    named = scratch.cut(docs.select(key, F.col(text).alias("_text")).mapInArrow(name, f"{fields(docs, [key])}, n_shingles long, set_id long, other long"))
    alone = F.when(F.min("other") == F.max("other"), F.min(key)).otherwise(F.raise_error(F.lit("two sets have one name")).cast(docs.schema[key].dataType))
    sets = scratch.cut(named.where("set_id is not null").groupBy("set_id").agg(alone.alias("least"), F.max("n_shingles").alias("n")))
    counts = {r.n: r["count"] for r in sets.where(F.col("n") <= MOST_LIGHT).groupBy("n").count().collect()}  # MOST_LIGHT rows at most
    boundary = choose_boundary(counts, part)
    classes = classes_from(boundary, sets.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0], part)

    def buckets(new: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        keys = [keys_of(items, boundary, classes, part) for _, items in new]
        ids = np.repeat(np.array([x for x, _ in new], np.int64), [len(k) for k in keys])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids)], names=["key", "id"])

    def whole(new: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in new], pa.int64()), pa.array([items.tobytes() for _, items in new], pa.binary())], names=["id", "items"])

    entries = _by_set(texts, buckets, "key long, id long", shingle)
    lists = scratch.cut(entries.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("key", "a"))
    scratch.settle()  # the entries are the largest shuffle here
    shared = scratch.cut(entries.join(_small(lists, MOST_LISTS), "key").distinct())
    scratch.settle()
    first = scratch.cut(shared.groupBy("id").agg(F.min("a").alias("a")))
    held = scratch.cut(_by_set(texts, whole, "id long, items binary", shingle).join(_small(first.select("id"), MOST_BROADCAST), "id", "left_semi").dropDuplicates(["id"]))
    sketches = scratch.cut(held.mapInArrow(_sketched, "id long, n long, sketch binary"))

    def close(pairs: DataFrame) -> DataFrame:
        ids = _small(scratch.cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), MOST_BROADCAST)
        need = held.join(ids, "id", "left_semi")
        with_a = pairs.join(need.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
        return with_a.join(need.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(lambda b: _linked(b, part), "a long, b long")

    star = scratch.cut(first.where("a < id").select("a", F.col("id").alias("b")))
    sized = star
    for end in ("a", "b"):
        sized = sized.join(sketches.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}")), end)
    links = scratch.cut(close(scratch.cut(sized.mapInArrow(lambda b: _passing(b, part), "a long, b long"))))
    found = components(links, scratch)
    tried = star.select("a", "b")
    for nearest in (*[True] * NEAREST, False):
        told = shared.select("key", "id").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = told.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / TILE).cast("int").alias("parts")).where("lo < hi").select("key", "parts")
        open_ = told.join(mixed, "key").withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        tiles = open_.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "p", "id", "root")
        rows = tiles.join(sketches, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        found_pairs = scratch.cut(rows.mapInArrow(lambda b, nearest=nearest: _tiled(b, nearest, part), "a long, b long").distinct())
        if found_pairs.isEmpty():
            break  # no pair that may link is open
        # A set that may link with no other is done with.
        open_ids = scratch.cut(found_pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        shared = scratch.cut(shared.join(_small(open_ids, MOST_BROADCAST), "id", "left_semi"))
        rest = scratch.cut(found_pairs.join(tried, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            tried = scratch.cut(tried.union(rest))
            links = scratch.cut(links.union(close(rest)))
            found = components(links, scratch)
    told = sets.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = told.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = told.join(least, "root").select("set_id", "component_id")
    return named.join(by_set, "set_id", "left").select(key, "n_shingles", "set_id", F.coalesce("component_id", key).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, part: int = PART) -> DataFrame:
    """One document of each component, that with the least key; documents without words all stay."""
    spark, names = docs.sparkSession, docs.columns
    here, who, lost_ = fresh(docs, "set_id", "key", "lost")
    scratch, inner = Scratch(spark, "keep-one"), Scratch(spark, "jaccard")
    told = scratch.cut(classes_of(docs, key, text, shingle, part, inner))
    inner.keep()

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data in batches_of(batches, text):
            ids = [fingerprint(x, _ONE) if len(x) else None for x in shingle_sets(data, shingle)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in names), pa.array(ids, pa.int64())], names=[*names, here])

    tagged = docs.mapInArrow(tag, f"{fields(docs, names)}, `{here}` long")
    in_sets = told.where("set_id is not null").select(F.col(key).alias("k"), "set_id", "component_id").groupBy("k", "set_id", "component_id").agg(F.count("*").alias("rows"))
    first = in_sets.where(F.col("k").eqNullSafe(F.col("component_id"))).groupBy(F.col("component_id").alias("c")).agg(F.min("set_id").alias("s"))
    ranked = in_sets.join(first, F.col("component_id").eqNullSafe(F.col("c")))
    wins = F.col("k").eqNullSafe(F.col("component_id")) & (F.col("set_id") == F.col("s"))
    lost = scratch.cut(ranked.where(~wins).select(F.col("k").alias(who), F.col("set_id").alias(lost_)))
    kept = tagged.join(held_small(lost, 16), (F.col(here) == F.col(lost_)) & F.col(key).eqNullSafe(F.col(who)), "left_anti")
    again = scratch.cut(ranked.where(wins & (F.col("rows") > 1)).select(F.col("set_id").alias(lost_)))
    if not again.isEmpty():
        on = F.col(here) == F.col(lost_)
        kept = kept.join(again, on, "left_anti").unionByName(kept.join(again, on, "left_semi").dropDuplicates([here]))
    return kept.select(*names)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the size of its set and the least doc_id reachable by links."""
    return classes_of(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
