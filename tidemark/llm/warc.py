"""Merkle fixity audit of WARC archives.

Records lie one after another in archives of ``ARCHIVE`` records. A leaf hashes a record's length and content;
each node above hashes its ``FAN`` children in order, so it stands for the range of offsets that its records fill. Two
replicas are compared at the root, and only the children of nodes that differ are looked at, level by
level, down to the records. A sound replica costs one comparison, ``k`` damaged records about
``k * FAN`` a level. Each replica's offsets come from its own lengths: where a record has grown, shrunk or gone, all
behind it in its archive lie elsewhere, and a finding gives the place in both replicas.

Cases: null addresses and payloads are empty; equal rows are separate records with neighbouring
numbers; a record that only one replica has is ``missing`` or ``extra``; an empty table has no tree and
no findings; columns named record_no, archive or offset are replaced by :func:`layout`, further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import Scratch, table
from tidemark.llm.sharding import number_rows

#: Children of a node, and records of an archive (a power of FAN, so that an archive is a subtree).
FAN, ARCHIVE = 16, 4096


def record(url: Column, page_id: Column, payload: Column) -> Column:
    """The bytes of a WARC resource record."""
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))), F.concat(F.lit("Content-Length: "), F.length(body).cast("string")), F.lit(""), F.lit(""))
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n"))


def placed(numbered: DataFrame) -> DataFrame:
    """Records with a record_no and a length, with the archive and the offset at which they lie."""
    before = Window.partitionBy("archive").orderBy("record_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.withColumn("archive", F.expr(f"record_no div {ARCHIVE}")).withColumn("offset", F.sum("length").over(before) - F.col("length"))


def numbered(records: DataFrame) -> DataFrame:
    """``records`` (digest first, further narrow columns) with a record_no, ordered by digest."""
    bucket = F.conv(F.substring("digest", 1, 3), 16, 10).cast("int")
    return number_rows(records.drop("record_no", "archive", "offset"), "record_no", "_total", bucket).drop("_total")


def layout(records: DataFrame) -> DataFrame:
    """``records`` (digest first, length, further narrow columns) with record_no, archive and offset, ordered by digest."""
    return placed(numbered(records))


def tree(leaves: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The levels of a tree, leaves first: rows (node, hash). ``leaves`` has record_no, length and digest."""
    level = scratch.cut(leaves.select(F.col("record_no").alias("node"), F.sha2(F.concat_ws(":", "length", "digest").cast("binary"), 256).alias("hash")))
    levels = [level]
    most = level.agg(F.max("node")).first()[0]
    while most:
        nodes = levels[-1].groupBy(F.expr(f"node div {FAN}").alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("kids"))  # FAN at most
        names = F.array_join(F.transform("kids", lambda k: F.concat_ws("=", k.node % FAN, k.hash)), "")
        levels.append(scratch.cut(nodes.select("node", F.sha2(names.cast("binary"), 256).alias("hash"))))
        most //= FAN
    return levels


def differing(one: list[DataFrame], other: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Record numbers whose leaves differ, found by descending from the roots."""
    depth = max(len(one), len(other))
    empty = one[0].limit(0)
    bad = None
    for level in reversed(range(depth)):
        mine, theirs = (x[level] if level < len(x) else empty for x in (one, other))
        if bad is not None:
            parent = F.expr(f"node div {FAN}")
            mine, theirs = (x.join(bad.select(F.col("node").alias("_parent")), parent == F.col("_parent"), "left_semi") for x in (mine, theirs))
        met = mine.select("node", F.col("hash").alias("_a")).join(theirs.select("node", F.col("hash").alias("_b")), "node", "full")
        bad = scratch.cut(met.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node"))
        if bad.isEmpty():
            break
    return bad


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """Damage between two replicas, each with record_no, archive, offset, length, digest and further columns.

    Rows: record_no, archive, offset, length and the further columns of the replica that has the record (the first, if both),
    offset and length in the other (-1, if it lacks the record), expected and found digests, and status.
    """
    scratch = Scratch(one.sparkSession, "fixity")
    bad = differing(tree(one, scratch), tree(other, scratch), scratch).withColumnRenamed("node", "record_no")
    mine, theirs = (x.join(bad, "record_no", "left_semi") for x in (one, other))
    a, b = mine.alias("a"), theirs.alias("b")
    rest = [c for c in one.columns if c not in ("record_no", "digest")]
    status = F.when(F.col("b.digest").isNull(), "missing").when(F.col("a.digest").isNull(), "extra").otherwise("changed")
    met = a.join(b, F.col("a.record_no") == F.col("b.record_no"), "full")
    either = [F.when(F.col("a.digest").isNotNull(), F.col(f"a.`{c}`")).otherwise(F.col(f"b.`{c}`")).alias(c) for c in rest]
    return met.select(F.coalesce("a.record_no", "b.record_no").alias("record_no"), *either, F.coalesce("b.offset", F.lit(-1)).alias("found_offset"), F.coalesce("b.length", F.lit(-1)).alias("found_length"), F.col("a.digest").alias("expected"), F.col("b.digest").alias("found"), status.alias("status"))


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of ``pages`` as laid down, and a worn replica laid out from its own bytes.

    By page_id modulo 251: of 7 the first byte of the payload is damaged, of 11 the last character is lost, records of 13 are
    gone, and records of 17 stand a second time behind all others.
    """
    of, html = F.coalesce(F.col("page_id") % 251, F.lit(-1)), F.col("html")
    rotten = F.when((of == 7) & html.startswith("<"), F.concat(F.lit("?"), F.expr("substring(html, 2)"))).when(of == 11, F.expr("substring(html, 1, length(html) - 1)")).otherwise(html)
    sound, worn = (record(F.col("url"), F.col("page_id"), x) for x in (html, rotten))
    narrow = pages.select(F.sha2(sound, 256).alias("digest"), F.sha2(worn, 256).alias("worn"), F.length(sound).cast("long").alias("length"), F.length(worn).cast("long").alias("worn_length"), "page_id", "url")
    scratch = Scratch(pages.sparkSession, "archive")
    laid = scratch.cut(layout(narrow))
    own = laid.select("record_no", F.col("worn").alias("digest"), F.col("worn_length").alias("length"), "page_id", "url")
    total = laid.agg(F.coalesce(F.max("record_no") + 1, F.lit(0))).first()[0]
    twice = numbered(own.where(F.coalesce(F.col("page_id") % 251, F.lit(-1)) == 17).select("digest", "length", "page_id", "url")).withColumn("record_no", F.col("record_no") + total)
    left = own.where(F.coalesce(F.col("page_id") % 251, F.lit(-1)) != 13)
    return laid.drop("worn", "worn_length"), scratch.cut(placed(left.unionByName(twice)))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a worn replica of the archives of all pages differs from the one laid down."""
    found = audit(*replicas(table(spark, sf_dir, "pages")))
    return found.select("record_no", "archive", "offset", "length", "page_id", "url", "found_offset", "found_length", "expected", "found", "status")


OP4_SQL = f"""
WITH r AS (SELECT page_id, url, coalesce(page_id % 251, -1) AS m, coalesce(html, '') AS sound,
             CASE WHEN page_id % 251 = 7 AND html LIKE '<%' THEN '?' || substr(html, 2) WHEN page_id % 251 = 11 THEN substr(coalesce(html, ''), 1, greatest(length(coalesce(html, '')) - 1, 0)) ELSE coalesce(html, '') END AS worn FROM pages),
h AS (SELECT *, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
             || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' AS head, chr(13) || chr(10) || chr(13) || chr(10) AS gap FROM r),
f AS (SELECT page_id, url, m, head || CAST(strlen(sound) AS VARCHAR) || gap || sound || gap AS sound, head || CAST(strlen(worn) AS VARCHAR) || gap || worn || gap AS worn FROM h),
d AS (SELECT page_id, url, m, sha256(sound) AS expected, sha256(worn) AS found, CAST(strlen(sound) AS BIGINT) AS length, CAST(strlen(worn) AS BIGINT) AS found_length FROM f),
o AS (SELECT *, row_number() OVER (ORDER BY expected, found, length, found_length, page_id, url) - 1 AS record_no FROM d),
a AS (SELECT *, CAST(sum(length) OVER (PARTITION BY record_no // {ARCHIVE} ORDER BY record_no) - length AS BIGINT) AS "offset" FROM o),
w AS (SELECT record_no, page_id, url, found AS digest, found_length AS length FROM o WHERE m <> 13
      UNION ALL SELECT row_number() OVER (ORDER BY found, found_length, page_id, url) - 1 + (SELECT count(*) FROM o), page_id, url, found, found_length FROM o WHERE m = 17),
b AS (SELECT *, CAST(sum(length) OVER (PARTITION BY record_no // {ARCHIVE} ORDER BY record_no) - length AS BIGINT) AS "offset" FROM w)
SELECT coalesce(a.record_no, b.record_no) AS record_no, coalesce(a.record_no, b.record_no) // {ARCHIVE} AS archive, coalesce(a."offset", b."offset") AS "offset", coalesce(a.length, b.length) AS length,
  CASE WHEN a.record_no IS NULL THEN b.page_id ELSE a.page_id END AS page_id, CASE WHEN a.record_no IS NULL THEN b.url ELSE a.url END AS url,
  coalesce(b."offset", -1) AS found_offset, coalesce(b.length, -1) AS found_length, a.expected, b.digest AS found,
  CASE WHEN b.record_no IS NULL THEN 'missing' WHEN a.record_no IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.record_no = b.record_no WHERE a.expected IS DISTINCT FROM b.digest
"""
