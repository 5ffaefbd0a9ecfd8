"""Term statistics: frequencies, document frequencies, sizes, postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccluster.functions.text import tokenize_filtered, tokenize_raw, with_bag

# Documents whose ids agree above the lowest CHUNK_BITS bits share one list, so a
# collected list never holds more than 2^CHUNK_BITS documents.
CHUNK_BITS = 16


def _explode_bag(bag: DataFrame, *keep: str) -> DataFrame:
    return bag.select(*keep, F.inline(F.arrays_zip("terms", "counts"))).select(
        *keep, F.col("terms").alias("term"), F.col("counts").alias("tf")
    )


def term_frequency(cat_docs: DataFrame) -> DataFrame:
    """``(cate, doc_id, term, tf)`` of filtered terms, without a shuffle."""
    bag = with_bag(cat_docs, tokenize_filtered(F.col("text")), "cate", "doc_id")
    return _explode_bag(bag, "cate", "doc_id")


def hashed_term(token: Column, num_features: int) -> Column:
    return F.pmod(F.hash(token), F.lit(num_features)).cast("string")


def raw_bags(docs: DataFrame, num_features: int | None = None) -> DataFrame:
    """``(doc_id, len, norm2, terms, counts)`` of raw tokens.

    ``num_features`` merges terms into hash buckets, as a hashed vector does.
    """
    tokens = tokenize_raw(F.col("text"))
    if num_features is not None:
        tokens = F.transform(tokens, lambda t: hashed_term(t, num_features))
    norm2 = F.aggregate("counts", F.lit(0).cast("bigint"), lambda acc, c: acc + c * c)
    return with_bag(docs, tokens, "doc_id").withColumn("norm2", norm2)


def term_frequency_raw(docs: DataFrame, num_features: int | None = None) -> DataFrame:
    """``(doc_id, term, tf)`` of raw tokens, without a shuffle."""
    return _explode_bag(raw_bags(docs, num_features), "doc_id")


def distinct_doc_terms(cat_docs: DataFrame) -> DataFrame:
    """``(cate, doc_id, term)``, each filtered term of a document once."""
    return cat_docs.select(
        "cate",
        "doc_id",
        F.explode(F.array_distinct(tokenize_filtered(F.col("text")))).alias("term"),
    )


def doc_length(docs: DataFrame) -> DataFrame:
    """``(doc_id, len)``: number of raw tokens."""
    return docs.select(
        "doc_id", F.size(tokenize_raw(F.col("text"))).cast("bigint").alias("len")
    )


def doc_norm(docs: DataFrame) -> DataFrame:
    """``(doc_id, norm)``: length of the raw term-frequency vector."""
    return raw_bags(docs).select("doc_id", F.sqrt("norm2").alias("norm"))


def category_size(cat_docs: DataFrame) -> DataFrame:
    """``(cate, n_docs)``; documents without any surviving term count too."""
    return cat_docs.groupBy("cate").agg(F.count("*").alias("n_docs"))


def corpus_size(cat_docs: DataFrame) -> DataFrame:
    """One row ``(n_docs)``."""
    return cat_docs.agg(F.count("*").alias("n_docs"))


def category_term_df(cat_docs: DataFrame, tf: DataFrame | None = None) -> DataFrame:
    """``(cate, term, df)``: documents of the category that hold the term.

    A written ``tf`` table of the same documents saves tokenising them again.
    """
    held = distinct_doc_terms(cat_docs) if tf is None else tf
    return held.groupBy("cate", "term").agg(F.count("*").alias("df"))


def term_df(cat_docs: DataFrame) -> DataFrame:
    """``(term, df)`` over all categories."""
    return distinct_doc_terms(cat_docs).groupBy("term").agg(F.count("*").alias("df"))


def vocabulary_size(docs: DataFrame) -> DataFrame:
    """One row ``(vocabulary)``: number of distinct raw tokens."""
    tokens = docs.select(
        F.explode(F.array_distinct(tokenize_raw(F.col("text")))).alias("term")
    )
    return tokens.distinct().agg(F.count("*").alias("vocabulary"))


def posting_lists(tf: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Inverted index ``(term, chunk, postings)``.

    Document ids are unique, so a list never holds more than ``2^chunk_bits``
    postings however many documents share the term; the chunks of a term, in
    order, are its whole list sorted by document.
    """
    return (
        tf.groupBy("term", F.shiftright("doc_id", chunk_bits).alias("chunk"))
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))
    )
