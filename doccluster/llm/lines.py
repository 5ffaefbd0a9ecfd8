"""Line deduplication by range-partitioned hashes, with keep bitmaps as its result.

Every line long enough becomes one row of 128 hash bits, document and position.
The rows are partitioned by ranges of the hash and sorted by hash, document
(largest first) and position, so one pass in that order meets the document that
keeps a line first and all others after it. Hashes that hold a large part of
the rows are told apart by sketches beforehand: their facts are aggregated map
side, and their rows are judged where they lie. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doccluster.sources.scratch import materialize

# --- fixed values -----------------------------------------------------------
BLANKS = " \t\n\u000b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LENGTH = 20
LEAST_DOCS = 3
# ----------------------------------------------------------------------------
# Hashes fall into this many sketches, each of which names its most frequent
# hashes: a hash that none names has at most about 1 / (SKETCHES * NAMED) of all
# rows. No more than SKETCHES * NAMED hashes are ever broadcast.
SKETCHES = 64
NAMED = 256
TRACKED = 2048
# Rows from which a hash is worth judging apart.
HOT_ROWS = 1000
KEEP = "array<struct<word:int,bits:bigint>>"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is A-Z to a-z on ASCII lines, and much faster than translate()
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def split_lines(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``(doc_id, text_key, position, h1, h2)`` of the lines that can repeat.

    ``text_key`` tells rows of one id with different texts apart.
    """
    keys = F.transform(split_lines(F.col("text")), line_key)
    lines = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        F.posexplode(keys).alias("position", "key"),
    ).filter(F.col("doc_id").isNotNull() & (F.char_length("key") >= least_length))
    return lines.select(
        "doc_id",
        "text_key",
        "position",
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit("second"), "key").alias("h2"),
    )


def hot_hashes(lines: DataFrame, least: int = HOT_ROWS) -> DataFrame:
    """``(h1)``: the hashes with many rows, at most ``SKETCHES * NAMED`` of them."""
    top = F.expr(f"approx_top_k(h1, {NAMED}, {TRACKED})")
    named = lines.groupBy(F.pmod("h1", F.lit(SKETCHES)).alias("sketch")).agg(top.alias("top"))
    return (
        named.select(F.inline("top"))
        .filter(F.col("count") >= least)
        .select(F.col("item").alias("h1"))
    )


def _judged_apart(hot_lines: DataFrame, least_docs: int) -> DataFrame:
    """Rows of hot hashes that go, by facts that are aggregated before the shuffle."""
    facts = hot_lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("_one"))
    facts = facts.groupBy("h1", "h2").agg(
        F.max("doc_id").alias("keeper"), F.count("*").alias("n_docs")
    )
    # a key of two columns, of which the first is one of the bounded number of hot ones
    gone = hot_lines.join(F.broadcast(facts), ["h1", "h2"])
    return gone.filter((F.col("n_docs") >= least_docs) & (F.col("doc_id") < F.col("keeper")))


def _judged_in_order(lines: DataFrame, least_docs: int) -> DataFrame:
    """Rows that go, met in the order of hash, document (largest first) and position."""
    ranged = lines.repartitionByRange("h1", "h2").sortWithinPartitions(
        "h1", "h2", F.desc("doc_id"), "position"
    )
    same = Window.partitionBy("h1", "h2")
    nth = F.dense_rank().over(same.orderBy(F.desc("doc_id")))
    met = ranged.withColumn("nth", nth).withColumn("n_docs", F.max("nth").over(same))
    return met.filter((F.col("nth") > 1) & (F.col("n_docs") >= least_docs))


def dropped_lines(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_docs: int = LEAST_DOCS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(doc_id, text_key, position)`` of every line that goes."""
    lines = materialize(line_hashes(docs, least_length), "line-hashes")
    hot = materialize(hot_hashes(lines, hot_rows), "hot-hashes")
    few = F.broadcast(hot)
    apart = _judged_apart(lines.join(few, "h1", "left_semi"), least_docs)
    in_order = _judged_in_order(lines.join(few, "h1", "left_anti"), least_docs)
    columns = ("doc_id", "text_key", "position")
    return in_order.select(*columns).unionByName(apart.select(*columns))


def keep_words(dropped: DataFrame) -> DataFrame:
    """``(doc_id, text_key, n_dropped, keep)``: compressed bitmaps of the kept lines.

    A bitmap is cut into words of 64 lines; a word that keeps all its lines is
    left out, and a text without any dropped line has no row.
    """
    bit = F.expr("shiftleft(1L, position & 63)")
    words = (
        dropped.repartition("doc_id", "text_key")
        .groupBy("doc_id", "text_key", F.shiftright("position", 6).alias("word"))
        .agg(F.bit_or(bit).alias("gone"))
    )
    kept = F.struct("word", F.bitwise_not("gone").alias("bits"))
    return words.groupBy("doc_id", "text_key").agg(
        F.sum(F.bit_count("gone")).cast("bigint").alias("n_dropped"),
        F.sort_array(F.collect_list(kept)).alias("keep"),
    )


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: dict[str, Column] | None = None,
    **limits: int,
) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, keep)`` of every row of ``docs``.

    A line's key is the line without blanks at its ends, A-Z in lower case.
    Keys of at least ``least_length`` code points found in at least
    ``least_docs`` documents lose all their lines except those of the largest
    id that holds them. ``keep`` is a bitmap as ``keep_words`` makes it, empty
    where every line stays; ``kept_text`` applies it. ``digest`` names further
    columns, made from ``text`` and ``keep``.

    Null and empty texts are one empty line. Rows that share an id are one
    document and each has its bitmap; rows with a null id hold no line that
    counts and keep all of theirs. Lines repeated inside the document that
    keeps them all stay. An empty table gives an empty result; other columns
    are not read, whatever their names.
    """
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    words = keep_words(dropped_lines(texts, **limits))
    none = F.array().cast(KEEP)
    columns = {
        "n_lines": F.size(split_lines(F.col("text"))).cast("bigint"),
        "n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("bigint"),
        "keep": F.col("keep"),
        **(digest or {}),
    }
    joined = texts.withColumn("text_key", F.xxhash64("text")).join(
        words, ["doc_id", "text_key"], "left"
    )
    joined = joined.withColumn("keep", F.coalesce("keep", none))
    return joined.select("doc_id", *[c.alias(name) for name, c in columns.items()])


def kept_text(text: Column, keep: Column) -> Column:
    """The text without the lines that its bitmap drops."""
    words = F.map_from_entries(keep)

    def stays(line: Column, position: Column) -> Column:
        bits = F.coalesce(F.try_element_at(words, F.shiftright(position, 6)), F.lit(-1))
        return F.call_function("shiftright", bits, position.bitwiseAND(63)).bitwiseAND(1) == 1

    some = F.array_join(F.filter(split_lines(text), stays), "\n")
    return F.when(F.size(keep) == 0, F.coalesce(text, F.lit(""))).otherwise(some)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents before dropping, dropped ones, and the kept text's SHA-256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = kept_text(F.col("text"), F.col("keep"))
    digest = {"kept_sha256": F.sha2(kept, 256)}
    return keep_bitmaps(docs, digest=digest).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP11_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(
        trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT k.doc_id, k.line, k.pos, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone
    FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
           AS kept_sha256
FROM judged GROUP BY doc_id
"""
