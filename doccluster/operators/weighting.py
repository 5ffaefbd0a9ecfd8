"""Term weighting: local information gain, information gain and their TF products.

The corpus-sized table in every weighting is the postings table ``tf``; it is
written once, so the texts are tokenised once, and shuffled once, for the join
that brings the term's score. Score tables have one row per (category, term) or
term and are aggregated before they move; category sizes are written, so that
the join by category knows their real size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doccluster.operators.stats import (
    category_size,
    category_term_df,
    corpus_size,
    term_frequency,
)
from doccluster.sources.scratch import materialize

# A selection of at most this many rows is joined by broadcast.
BROADCAST_ROWS = 100_000


def select_top(df: DataFrame, n: int, *order: Column) -> tuple[DataFrame, bool]:
    """The first ``n`` rows, and whether they are few enough to broadcast."""
    return df.orderBy(*order).limit(n), n <= BROADCAST_ROWS


def join_selected(big: DataFrame, selected: DataFrame, small: bool, on: list[str]) -> DataFrame:
    return big.join(F.broadcast(selected) if small else selected, on)


def _guarded_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).otherwise(F.lit(0.0))


def written_tf(cat_docs: DataFrame, tf: DataFrame | None) -> DataFrame:
    """``tf`` if there is one, else the documents' postings, written."""
    return materialize(term_frequency(cat_docs), "tf") if tf is None else tf


def written_cdf(cat_docs: DataFrame, tf: DataFrame | None) -> DataFrame:
    """Document frequencies per category and term, written."""
    return materialize(category_term_df(cat_docs, tf), "cdf")


def written_sizes(cat_docs: DataFrame) -> DataFrame:
    return materialize(category_size(cat_docs), "category-sizes")


def term_scores(
    cat_docs: DataFrame, tf: DataFrame | None = None, cdf: DataFrame | None = None
) -> DataFrame:
    """``(term, lig, ig)`` of every filtered term.

    Both sums run over the categories that hold the term. One shuffle by term
    serves the document frequency and both sums; a term's group has at most
    one row per category. Written tables ``tf`` or ``cdf`` of the same documents
    save tokenising them again.
    """
    cdf = category_term_df(cat_docs, tf) if cdf is None else cdf
    n = corpus_size(cat_docs).scalar()
    by_term = Window.partitionBy("term")
    cells = (
        cdf.join(written_sizes(cat_docs), "cate")
        .select(
            "term",
            (F.sum("df").over(by_term) / n).alias("p_t"),
            (F.col("n_docs") / n).alias("p_c"),
            (F.col("df") / n).alias("p_ct"),
        )
        .withColumn("p_cnt", F.col("p_c") - F.col("p_ct"))
        .withColumn("e_t", F.col("p_c") * F.col("p_t"))
        .withColumn("e_nt", F.col("p_c") * (1 - F.col("p_t")))
    )

    def smoothed(p: str) -> Column:
        return F.col(p) * (1 - _guarded_log(F.col(p)))

    def divergence(p: str, expected: str) -> Column:
        ratio = F.try_divide(F.col(p), F.col(expected))
        return F.col(p) * F.coalesce(_guarded_log(ratio), F.lit(0.0))

    lig = F.abs(smoothed("p_ct") - smoothed("e_t")) + F.abs(smoothed("p_cnt") - smoothed("e_nt"))
    ig = divergence("p_ct", "e_t") + divergence("p_cnt", "e_nt")
    return cells.groupBy("term").agg(F.sum(lig).alias("lig"), F.sum(ig).alias("ig"))


def lig(cat_docs: DataFrame) -> DataFrame:
    """``(term, lig)``: local information gain."""
    return term_scores(cat_docs).select("term", "lig")


def ig(cat_docs: DataFrame) -> DataFrame:
    """``(term, ig)``: information gain."""
    return term_scores(cat_docs).select("term", "ig")


def category_term_scores(
    cat_docs: DataFrame, scores: DataFrame | None = None, tf: DataFrame | None = None
) -> DataFrame:
    """``(cate, term, lig, ig)`` of the terms each category uses."""
    cdf = written_cdf(cat_docs, tf)
    scores = term_scores(cat_docs, cdf=cdf) if scores is None else scores
    return cdf.select("cate", "term").join(scores, "term").select("cate", "term", "lig", "ig")


def tf_icdf(
    cat_docs: DataFrame, top_n: int | None = None, tf: DataFrame | None = None
) -> DataFrame:
    """``ln(1+tf) * ln(n_c / df(c,t))`` as ``(cate, doc_id, term, weight)``.

    ``top_n`` keeps only the (category, term) pairs with the largest document
    frequency over the whole corpus, so a category can end up without terms.
    """
    tf = written_tf(cat_docs, tf)
    cdf = category_term_df(cat_docs, tf)
    small = False
    if top_n is not None:
        cdf, small = select_top(cdf, top_n, F.desc("df"), F.col("cate"), F.col("term"))
    icdf = cdf.join(written_sizes(cat_docs), "cate").select(
        "cate", "term", F.log(F.col("n_docs") / F.col("df")).alias("icdf")
    )
    return join_selected(tf, icdf, small, ["cate", "term"]).select(
        "cate", "doc_id", "term", (F.log1p("tf") * F.col("icdf")).alias("weight")
    )


def scored_tf(tf: DataFrame, scores: DataFrame) -> DataFrame:
    """``tf`` with the columns of ``scores``, which has one row per term.

    The weightings below take it in place of ``tf``, so that several share one
    join. A part of ``scores`` is hashed in a task; the postings are not sorted.
    """
    return tf.join(scores.hint("shuffle_hash"), "term")


def _tf_times(
    cat_docs: DataFrame,
    score: str,
    factor: Column,
    tf: DataFrame | None,
    scores: DataFrame | None,
) -> DataFrame:
    if tf is None or score not in tf.columns:
        tf = written_tf(cat_docs, tf)
        scores = term_scores(cat_docs, tf) if scores is None else scores
        tf = scored_tf(tf, scores.select("term", score))
    return tf.select("cate", "doc_id", "term", (factor * F.col(score)).alias("weight"))


def tf_lig(cat_docs: DataFrame, tf=None, scores=None) -> DataFrame:
    """``tf * lig(t)``."""
    return _tf_times(cat_docs, "lig", F.col("tf"), tf, scores)


def log_tf_lig(cat_docs: DataFrame, tf=None, scores=None) -> DataFrame:
    """``ln(1+tf) * lig(t)``."""
    return _tf_times(cat_docs, "lig", F.log1p("tf"), tf, scores)


def log_tf_ig(cat_docs: DataFrame, tf=None, scores=None) -> DataFrame:
    """``ln(1+tf) * ig(t)``."""
    return _tf_times(cat_docs, "ig", F.log1p("tf"), tf, scores)


def doc_weight_vectors(weights: DataFrame) -> DataFrame:
    """``(cate, doc_id, terms)``: each document's weighted terms, by term.

    A list is at most as long as its document has distinct terms.
    """
    return weights.groupBy("cate", "doc_id").agg(
        F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms")
    )
