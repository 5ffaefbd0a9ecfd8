"""Whole term-weighting jobs that write their outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from doccluster.operators.stats import term_frequency
from doccluster.operators.weighting import (
    category_term_scores,
    doc_weight_vectors,
    log_tf_ig,
    log_tf_lig,
    scored_tf,
    term_scores,
    tf_icdf,
    tf_lig,
)
from doccluster.sources.scratch import materialize
from doccluster.sources.writers import write_by_category, write_overwrite


def write_term_scores(cat_docs: DataFrame, path: str, file_format: str = "parquet") -> None:
    """All scores and, per category, scores and both log-TF weightings.

    Writes ``lig_all``, ``lig``, ``tflig`` and ``tfig`` under ``path``; the last
    three hold one directory per category. Postings and scores are computed
    once, and joined and grouped by category once, for both weightings.
    """
    tf = materialize(term_frequency(cat_docs), "tf")
    scores = materialize(term_scores(cat_docs, tf), "scores")
    write_overwrite(scores, f"{path}/lig_all", file_format)
    by_category = category_term_scores(cat_docs, scores, tf)
    write_by_category(by_category, f"{path}/lig", "cate", file_format)
    scored = materialize(scored_tf(tf, scores).hint("rebalance", "cate"), "scored-tf")
    for weigh, name in ((log_tf_lig, "tflig"), (log_tf_ig, "tfig")):
        weights = weigh(cat_docs, scored)
        write_by_category(weights, f"{path}/{name}", "cate", file_format, grouped=True)


def write_tf_lig(cat_docs: DataFrame, path: str, file_format: str = "parquet") -> None:
    """TF*LIG vectors per document."""
    tf = materialize(term_frequency(cat_docs), "tf")
    write_overwrite(doc_weight_vectors(tf_lig(cat_docs, tf)), path, file_format)


def write_tf_icdf(
    cat_docs: DataFrame, path: str, top_n: int | None = None, file_format: str = "parquet"
) -> None:
    """TF*ICDF vectors per document."""
    tf = materialize(term_frequency(cat_docs), "tf")
    write_overwrite(doc_weight_vectors(tf_icdf(cat_docs, top_n, tf)), path, file_format)
