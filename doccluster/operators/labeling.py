"""Cluster labels: the terms that describe each category best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doccluster.operators.weighting import (
    join_selected,
    select_top,
    term_scores,
    written_cdf,
)

# --- fixed values -----------------------------------------------------------
LABELS_PER_CLUSTER = 10
ALL_FEATURES = "all"
# ----------------------------------------------------------------------------


def select_features_by_lig(scores: DataFrame, n: int) -> DataFrame:
    """``(term, lig)`` of the ``n`` terms with the largest LIG, ties by term."""
    return select_top(scores.select("term", "lig"), n, F.desc("lig"), F.col("term"))[0]


def df_lig(cat_docs: DataFrame, num_features: int | str = ALL_FEATURES) -> DataFrame:
    """``df(c,t) * lig(t)`` as ``(cate, term, weight)``, for all or the best terms."""
    cdf = written_cdf(cat_docs, None)
    scores = term_scores(cat_docs, cdf=cdf).select("term", "lig")
    small = False
    if num_features != ALL_FEATURES:
        scores, small = select_top(scores, int(num_features), F.desc("lig"), F.col("term"))
    return join_selected(cdf, scores, small, ["term"]).select(
        "cate", "term", (F.col("df") * F.col("lig")).alias("weight")
    )


def cluster_labels(
    cat_docs: DataFrame,
    num_features: int | str = ALL_FEATURES,
    k: int = LABELS_PER_CLUSTER,
) -> DataFrame:
    """``(cate, rank, term, weight)``: the ``k`` best terms of each category.

    The rank limit is applied before the shuffle too, so a category sends at
    most ``k`` rows per task however many terms it has.
    """
    best = Window.partitionBy("cate").orderBy(F.desc("weight"), "term")
    return (
        df_lig(cat_docs, num_features)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("cate", F.col("rank").cast("bigint").alias("rank"), "term", "weight")
    )


def nest_labels(labels: DataFrame) -> DataFrame:
    """``(cate, labels)``: each category's ranked labels as one list."""
    return labels.groupBy("cate").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "term", "weight"))),
            lambda row: F.struct(row["term"].alias("term"), row["weight"].alias("weight")),
        ).alias("labels")
    )
