"""Merkle fixity audit of WARC records and their replicas.

Records lie in files in order of their offsets. The records of a key make a leaf; a
node covers a range of ``FANOUT`` nodes below, in order, and its hash is that
of their hashes; a file has one root. Two replicas are compared root by root,
and only below nodes that differ are their children compared, level by level,
down to the records that differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doccluster.sources.scratch import materialize

FANOUT = 16
LEVELS = 3
# Records of one file: a full tree of LEVELS levels above the leaves.
FILE_RECORDS = FANOUT**LEVELS
# Parts of 60 bits that stand for a hash in a sum.
PARTS = 4
HEADER = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "


def warc_record(url: Column, html: Column) -> Column:
    """The bytes of a WARC response record; null parts count as empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit(HEADER),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def leaves(records: DataFrame, key_col: str = "page_id") -> DataFrame:
    """``(file, node, key, copies, start, size, hash)``, a row per key.

    ``records`` holds the key and ``record``, a string. File ``n`` holds the
    keys ``n * FILE_RECORDS`` on and a key has a fixed place in it, so a record
    that a replica lacks does not move others, and no file has more leaves than
    that. All records of a key make one leaf, by the sums of the parts of their
    SHA-256 hashes: they are added up before the shuffle, however often a key
    repeats. Records with a null key are placed by their hash, in files with
    negative numbers.
    """
    digest = F.sha2(F.col("record"), 256)
    hashed = records.select(
        F.col(key_col).cast("bigint").alias("key"),
        F.octet_length("record").cast("bigint").alias("size"),
        *[
            F.conv(F.substring(digest, 1 + n * 15, 15), 16, 10).cast("decimal(38,0)").alias(f"part{n}")
            for n in range(PARTS)
        ],
    )
    by_hash = -1 - F.pmod(F.col("part0"), F.lit(1 << 40)).cast("bigint")
    grouped = (
        hashed.withColumn("place", F.coalesce("key", by_hash))
        .groupBy("key", "place")
        .agg(
            F.count("*").alias("copies"),
            F.sum("size").alias("size"),
            *[F.sum(f"part{n}").cast("string").alias(f"part{n}") for n in range(PARTS)],
        )
        .withColumn("file", F.floor(F.col("place") / FILE_RECORDS).cast("bigint"))
    )
    before = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parts = [F.col(f"part{n}") for n in range(PARTS)]
    return grouped.select(
        "file",
        F.pmod("place", F.lit(FILE_RECORDS)).alias("node"),
        "key",
        "copies",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"),
        "size",
        F.sha2(
            F.concat_ws(":", F.col("place").cast("string"), F.col("copies").cast("string"), *parts), 256
        ).alias("hash"),
    )


def tree(records: DataFrame, key_col: str = "page_id") -> DataFrame:
    """``(file, level, node, key, copies, start, size, hash)``: all files' trees.

    Level 0 holds the leaves, level LEVELS the roots. Every level is written.
    """
    level = leaves(records, key_col).select(
        "file", F.lit(0).alias("level"), "node", "key", "copies", "start", "size", "hash"
    )
    levels = [materialize(level, "leaves")]
    for n in range(1, LEVELS + 1):
        # at most FANOUT nodes
        parts = F.array_sort(F.collect_list(F.struct("node", "hash")))
        above = (
            levels[-1]
            .groupBy("file", F.floor(F.col("node") / FANOUT).cast("bigint").alias("node"))
            .agg(
                F.sum("copies").alias("copies"),
                F.min("start").alias("start"),
                F.sum("size").alias("size"),
                F.sha2(F.array_join(F.transform(parts, lambda p: p["hash"]), ""), 256).alias("hash"),
            )
        )
        levels.append(
            materialize(
                above.select(
                    "file",
                    F.lit(n).alias("level"),
                    "node",
                    F.lit(None).cast("bigint").alias("key"),
                    "copies",
                    "start",
                    "size",
                    "hash",
                ),
                "level",
            )
        )
    return reduce(DataFrame.unionByName, levels)


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """All nodes that differ between two written trees, from the roots down.

    ``(file, level, node, first_hash, second_hash)``. Children are compared only
    below nodes that differ. At level 0 a row is a key whose records are damaged,
    missing or more in one replica; a hash is null where a replica has no such
    node. Two equal or two empty trees give no rows.
    """
    found: list[DataFrame] = []
    for n in range(LEVELS, -1, -1):
        sides = []
        for nodes, name in ((first, "first"), (second, "second")):
            side = nodes.filter(F.col("level") == n).select(
                "file", "node", F.col("hash").alias(f"{name}_hash")
            )
            if found:
                above = found[-1].select("file", F.col("node").alias("above"))
                side = side.withColumn("above", F.floor(F.col("node") / FANOUT).cast("bigint")).join(
                    above, ["file", "above"], "left_semi"
                )
            sides.append(side.select("file", "node", f"{name}_hash"))
        differing = (
            sides[0]
            .join(sides[1], ["file", "node"], "full")
            .filter(~F.col("first_hash").eqNullSafe(F.col("second_hash")))
            .select("file", F.lit(n).alias("level"), "node", "first_hash", "second_hash")
        )
        found.append(materialize(differing, "differing"))
    return reduce(DataFrame.unionByName, found)


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A replica of the pages with faults at places that follow from the ids.

    Of every 997 ids one record has lost its last character, one is missing and
    one has another URL.
    """
    place = F.pmod("page_id", F.lit(997))
    html = F.when(place == 101, F.expr("substring(html, 1, length(html) - 1)")).otherwise(F.col("html"))
    url = F.when(place == 303, F.concat("url", F.lit("#"))).otherwise(F.col("url"))
    return pages.filter((place != 202) | place.isNull()).select("page_id", url.alias("url"), html.alias("html"))


def op3_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the pages' trees and what a damaged replica has there.

    ``state`` is ``same``, ``differs`` or ``missing``; a node below a node that
    is the same was not visited and is ``same`` by its ancestor's hash.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    record = warc_record(F.col("url"), F.col("html")).alias("record")
    first = tree(pages.select("page_id", record))
    second = tree(damaged_replica(pages).select("page_id", record))
    found = audit(first, second).withColumn("visited", F.lit(True))
    return first.join(found, ["file", "level", "node"], "left").select(
        "file",
        "level",
        "node",
        "key",
        "start",
        "size",
        "hash",
        F.when(F.col("visited").isNull(), "same")
        .when(F.col("second_hash").isNull(), "missing")
        .otherwise("differs")
        .alias("state"),
    )


OP3_SQL = """
WITH fields AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), replica AS (
  SELECT page_id,
         CASE WHEN page_id % 997 = 303 THEN url || '#' ELSE url END AS url,
         CASE WHEN page_id % 997 = 101 THEN left(html, greatest(length(html) - 1, 0)) ELSE html END AS html
  FROM fields WHERE page_id % 997 <> 202
), record AS (
  SELECT 1 AS copy, page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
         || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM fields
  UNION ALL
  SELECT 2, page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
         || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)
  FROM replica
), hashed AS (
  SELECT copy, page_id AS key, strlen(r) AS size, sha256(r) AS h FROM record
), counted AS (
  SELECT copy, key, count(*) AS copies, sum(size) AS size,
         sum(('0x' || h[1:15])::BIGINT) || ':' || sum(('0x' || h[16:30])::BIGINT) || ':'
         || sum(('0x' || h[31:45])::BIGINT) || ':' || sum(('0x' || h[46:60])::BIGINT) AS parts
  FROM hashed GROUP BY copy, key
), leaf AS (
  SELECT copy, key // 4096 AS file, 0 AS level, key % 4096 AS node, key, copies,
         coalesce(sum(size) OVER (PARTITION BY copy, key // 4096 ORDER BY key
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         size, sha256(key || ':' || copies || ':' || parts) AS hash
  FROM counted
), one AS (
  SELECT copy, file, 1 AS level, node // 16 AS node, NULL AS key, sum(copies) AS copies, min(start) AS start,
         sum(size) AS size, sha256(string_agg(hash, '' ORDER BY node)) AS hash
  FROM leaf GROUP BY copy, file, node // 16
), two AS (
  SELECT copy, file, 2 AS level, node // 16 AS node, NULL AS key, sum(copies) AS copies, min(start) AS start,
         sum(size) AS size, sha256(string_agg(hash, '' ORDER BY node)) AS hash
  FROM one GROUP BY copy, file, node // 16
), three AS (
  SELECT copy, file, 3 AS level, node // 16 AS node, NULL AS key, sum(copies) AS copies, min(start) AS start,
         sum(size) AS size, sha256(string_agg(hash, '' ORDER BY node)) AS hash
  FROM two GROUP BY copy, file, node // 16
), nodes AS (
  SELECT * FROM leaf UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three
)
SELECT a.file, a.level, a.node, a.key, CAST(a.start AS BIGINT) AS start, CAST(a.size AS BIGINT) AS size, a.hash,
       CASE WHEN a.hash = b.hash THEN 'same' WHEN b.hash IS NULL THEN 'missing' ELSE 'differs' END AS state
FROM (SELECT * FROM nodes WHERE copy = 1) a
LEFT JOIN (SELECT * FROM nodes WHERE copy = 2) b ON a.file = b.file AND a.level = b.level AND a.node = b.node
"""
