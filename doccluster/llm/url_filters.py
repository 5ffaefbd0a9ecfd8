"""URL filters by a temporal join with dated list entries.

A list is a history of dated entries for domains. Each entry holds until the
next one for its domain, which gives validity intervals; every capture is met
with the entries of its host and the host's parent domains that were valid on
the day it was fetched, and the most specific one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doccluster.llm.columns import unused

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
# Days per bucket of the as-of join.
BUCKET_DAYS = 32
# Fixed values of the query: days that captures and entries are spread over.
DAYS = 730
ENTRIES = 4


def host_of(url: Column) -> Column:
    """Lower-cased host; null where the URL is null or has none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def validity(entries: DataFrame) -> DataFrame:
    """``(domain, valid_from, valid_to, action)`` from ``(domain, day, action)``.

    Of several entries for a domain on one day the largest action counts, so a
    domain has at most one interval a day. The last interval is open: its
    ``valid_to`` is null. Entries with a null domain or day are left out.
    """
    daily = (
        entries.filter("domain IS NOT NULL AND day IS NOT NULL")
        .groupBy("domain", "day")
        .agg(F.max("action").alias("action"))
    )
    following = F.lead("day").over(Window.partitionBy("domain").orderBy("day"))
    return daily.select(
        "domain", F.col("day").alias("valid_from"), following.alias("valid_to"), "action"
    )


def _parents(host: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.transform(starts, lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))


def active_entries(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """``(host, day, domain, valid_from, valid_to, action)``: what decides.

    One row per distinct host and day of ``captures`` for which an entry was
    valid. Both sides meet by domain and by bucket of days, so a domain with
    many captures or entries is spread over its buckets.
    """
    asked = captures.filter("host IS NOT NULL AND day IS NOT NULL").select("host", "day").distinct()
    asked = asked.select("host", "day", F.explode(_parents(F.col("host"))).alias("domain")).withColumn(
        "bucket", F.floor(F.col("day") / BUCKET_DAYS)
    )
    last = captures.agg(F.max("day")).scalar()
    until = F.least(F.coalesce(F.col("valid_to") - 1, last), last)
    first_bucket, last_bucket = F.floor(F.col("valid_from") / BUCKET_DAYS), F.floor(until / BUCKET_DAYS)
    spread = intervals.filter(last_bucket >= first_bucket).select(
        "*", F.explode(F.sequence(first_bucket, last_bucket)).alias("bucket")
    )
    at = F.col("day")
    valid = (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    # an entry for a longer domain comes first
    rank = F.struct(F.length("domain").alias("n"), "domain", "valid_from", "valid_to", "action")
    return (
        asked.join(spread, ["domain", "bucket"])
        .filter(valid)
        .groupBy("host", "day")
        .agg(F.max(rank).alias("rank"))
        .select("host", "day", "rank.domain", "rank.valid_from", "rank.valid_to", "rank.action")
    )


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` with ``domain, valid_from, valid_to, action`` of the entry that decides.

    ``captures`` holds ``host`` and ``day`` besides other columns, which all
    stay. Where one of them has the name of one of the four, the entry's column
    has underscores before its name. The four are null where no entry was valid,
    or host or day is null; repeated rows stay. The join back is on host and day
    together.
    """
    decided = active_entries(captures.select("host", "day"), validity(entries))
    names = {column: unused(captures, column) for column in decided.columns}
    host, day = names["host"], names["day"]
    renamed = decided.withColumnsRenamed(names)
    return captures.join(
        renamed, (captures["host"] == F.col(host)) & (captures["day"] == F.col(day)), "left"
    ).drop(host, day)


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def dated_entries(hosts: DataFrame) -> DataFrame:
    """A list history over the hosts and their parents, from hashes of their names.

    Every domain has one to ENTRIES entries that block or allow it.
    """
    domains = hosts.select(F.explode(_parents(F.col("host"))).alias("domain")).distinct()
    number = _number(F.col("domain"))
    turns = F.sequence(F.lit(0), F.pmod(number, F.lit(ENTRIES)).cast("int"))
    return domains.select("domain", number.alias("number"), F.explode(turns).alias("turn")).select(
        "domain",
        F.pmod(F.floor(F.col("number") / (F.col("turn") * 13 + 7)), F.lit(DAYS)).alias("day"),
        F.when(F.pmod(F.floor(F.col("number") / (F.col("turn") * 5 + 3)), F.lit(3)) == 0, "allow")
        .otherwise("block")
        .alias("action"),
    )


def op6_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by the entries valid on the day it was fetched."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        F.pmod(F.col("page_id") * 7919, F.lit(DAYS)).alias("day"),
    )
    hosts = captures.filter("host IS NOT NULL").select("host").distinct()
    return filter_urls(captures, dated_entries(hosts)).select(
        "page_id",
        "host",
        "day",
        "domain",
        "valid_from",
        "valid_to",
        F.coalesce("action", F.lit("unlisted")).alias("verdict"),
    )


OP6_SQL = """
WITH capture AS (
  SELECT page_id, CASE WHEN host <> '' THEN host END AS host, page_id * 7919 % 730 AS day
  FROM (SELECT page_id, lower(regexp_extract(url,
          '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM pages)
), labels AS (
  SELECT DISTINCT host, string_split(host, '.') AS l FROM capture WHERE host IS NOT NULL
), parent AS (
  SELECT host, array_to_string(l[n:], '.') AS domain
  FROM (SELECT host, l, unnest(range(1, greatest(len(l) - 1, 1) + 1)) AS n FROM labels)
), named AS (
  SELECT domain, ('0x' || md5(domain)[1:8])::BIGINT AS number FROM (SELECT DISTINCT domain FROM parent)
), entry AS (
  SELECT domain, number // (turn * 13 + 7) % 730 AS day,
         max(CASE WHEN number // (turn * 5 + 3) % 3 = 0 THEN 'allow' ELSE 'block' END) AS action
  FROM (SELECT domain, number, unnest(range(0, number % 4 + 1)) AS turn FROM named)
  GROUP BY 1, 2
), validity AS (
  SELECT domain, action, day AS valid_from, lead(day) OVER (PARTITION BY domain ORDER BY day) AS valid_to
  FROM entry
), ranked AS (
  SELECT c.page_id, c.host, c.day, v.domain, v.valid_from, v.valid_to, v.action,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.domain) DESC) AS place
  FROM capture c JOIN parent p ON p.host = c.host
  JOIN validity v ON v.domain = p.domain AND v.valid_from <= c.day AND (v.valid_to IS NULL OR c.day < v.valid_to)
)
SELECT c.page_id, c.host, c.day, r.domain, r.valid_from, r.valid_to, coalesce(r.action, 'unlisted') AS verdict
FROM capture c LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r ON r.page_id = c.page_id
"""
