"""Sources: plain and categorised document lines, gold labels, tag lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(line: Column, count: int) -> list[Column]:
    parts = F.split(line, " ", count)
    return [F.get(parts, n) for n in range(count)]


def _parse_lines(lines: DataFrame, categorized: bool) -> DataFrame:
    if categorized:
        cate, doc_id, text = _fields(F.col("value"), 3)
        return lines.select(
            cate.alias("cate"), doc_id.try_cast("bigint").alias("doc_id"), text.alias("text")
        )
    doc_id, text = _fields(F.col("value"), 2)
    return lines.select(doc_id.try_cast("bigint").alias("doc_id"), text.alias("text"))


def _at_least(df: DataFrame, min_partitions: int | None) -> DataFrame:
    """Spread a scan of few large files over so many partitions.

    A scan that has them already is left alone: its texts are not shuffled.
    """
    if min_partitions is None or df.rdd.getNumPartitions() >= min_partitions:
        return df
    return df.repartition(min_partitions)


def _well_formed() -> Column:
    return F.col("doc_id").isNotNull() & F.col("text").isNotNull()


def read_docs(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """``docid text`` lines as ``(doc_id, text)``.

    Lines without a numeric id and a space are dropped; ``malformed_lines``
    lists them. ``min_partitions`` spreads an input of few large files.
    """
    docs = _parse_lines(spark.read.text(path), categorized=False).filter(_well_formed())
    return _at_least(docs, min_partitions)


def read_categorized_docs(
    spark: SparkSession, path: str, min_partitions: int | None = None
) -> DataFrame:
    """``cate docid text`` lines as ``(cate, doc_id, text)``."""
    docs = _parse_lines(spark.read.text(path), categorized=True).filter(_well_formed())
    return _at_least(docs, min_partitions)


def malformed_lines(spark: SparkSession, path: str, categorized: bool = False) -> DataFrame:
    """The lines the two readers above drop."""
    fields = _fields(F.col("value"), 3 if categorized else 2)
    return spark.read.text(path).filter(
        fields[-1].isNull() | fields[-2].try_cast("bigint").isNull()
    )


def docs_from_table(
    df: DataFrame,
    id_col: str,
    text_col: str,
    cate_col: str | None = None,
    min_partitions: int | None = None,
) -> DataFrame:
    """Any table as plain or categorised documents."""
    columns = [F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")]
    if cate_col is not None:
        columns.insert(0, F.col(cate_col).cast("string").alias("cate"))
    return _at_least(df.select(*columns), min_partitions)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """``docid label`` lines after one header line per file, as ``(doc_id, label)``."""
    lines = (
        spark.read.schema("value string")
        .option("header", True)
        .option("enforceSchema", True)
        .option("sep", "\u0001")
        .option("quote", "")
        .csv(path)
    )
    doc_id, label = _fields(F.col("value"), 2)
    return lines.select(
        doc_id.try_cast("bigint").alias("doc_id"), label.alias("label")
    ).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """One label per line, as ``(label)``."""
    return spark.read.text(path).select(F.col("value").alias("label"))
