"""Registered queries: every operator over the whole given tables.

``cate`` is the language and the plain corpus is the whole ``documents`` table
unless a query says otherwise. Fractions are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doccluster.functions.text import normalize_text, tokenize_filtered, tokenize_raw
from doccluster.operators import evaluation, kmeans, labeling, propagation, similarity, stats
from doccluster.operators import weighting
from doccluster.plans.clustering import append_sweep_reports, ap_topn_sweep, cluster_documents_ap
from doccluster.plans.jobs import write_ap_clusters, write_cluster_labels, write_kmeans_assignments
from doccluster.plans.term_weights import write_term_scores, write_tf_icdf, write_tf_lig
from doccluster.sources.readers import (
    docs_from_table,
    malformed_lines,
    read_categorized_docs,
    read_docs,
    read_gold,
    read_tags,
)
from doccluster.sources.scratch import materialize, scratch_path
from doccluster.sources.writers import append_report, write_by_category, write_overwrite

Query = Callable[[SparkSession, str], DataFrame]

ROUNDS = 10
NEIGHBORS = 10
CENTERS = 4
KMEANS_ROUNDS = 10
SEED = 7
FEATURES = 500
PREFERENCE = 100.0
# Under this one some documents, and not all, are exemplars.
FREY_PREFERENCE = -200.0
LINE_BREAKS = r"[\r\n]+"


def rounded(value: str | Column, name: str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return (F.round(column, 6) + F.lit(0.0)).alias(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_from_table(
        documents(spark, sf_dir),
        "doc_id",
        "text",
        min_partitions=spark.sparkContext.defaultParallelism,
    )


def categorized(spark: SparkSession, sf_dir: str, cate_col: str) -> DataFrame:
    return docs_from_table(
        documents(spark, sf_dir),
        "doc_id",
        "text",
        cate_col,
        min_partitions=spark.sparkContext.defaultParallelism,
    )


def cat_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorized(spark, sf_dir, "lang")


def over_docs(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(docs(spark, sf_dir))


def over_cat_docs(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(cat_docs(spark, sf_dir))


def weights(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", rounded("weight", "weight"))


def edges(df: DataFrame) -> DataFrame:
    return df.select("i", "k", rounded_fast("s"))


def rounded_fast(name: str) -> Column:
    """``rounded`` without decimal arithmetic, except where that could differ.

    Below 2^20 a product of doubles is off by less than a thousandth of a millionth, so
    only values that lie so near the middle of two millionths go through ``round``.
    """
    micros = F.abs(name) * 1_000_000
    whole = F.floor(micros)
    beyond = micros - whole - 0.5
    size = F.when(beyond > 0, whole + 1).otherwise(whole)
    near = F.when(F.col(name) < 0, -size).otherwise(size) / 1_000_000 + F.lit(0.0)
    clear = (F.abs(name) < float(1 << 20)) & (F.abs(beyond) > 0.001)
    return F.when(clear, near).otherwise(rounded(name, name)).alias(name)


def positioned(tokens: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select("doc_id", F.posexplode(tokens(F.col("text")))).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("col").alias("term")
    )


def pair_list(terms: Column, name: str, number: str) -> Column:
    return F.array_join(
        F.transform(terms, lambda t: F.concat_ws(":", t[name], t[number].cast("string"))), " "
    )


def posting_lists(df: DataFrame) -> DataFrame:
    lists = stats.posting_lists(stats.term_frequency(df))
    return lists.select(
        "term", "chunk", pair_list(F.col("postings"), "doc_id", "tf").alias("postings")
    )


def doc_weight_vectors(df: DataFrame) -> DataFrame:
    micro = weighting.tf_icdf(df).select(
        "cate", "doc_id", "term", F.round(F.col("weight") * 1_000_000).cast("bigint").alias("weight")
    )
    return weighting.doc_weight_vectors(micro).select(
        "cate",
        "doc_id",
        F.size("terms").cast("bigint").alias("n_terms"),
        pair_list(F.col("terms"), "term", "weight").alias("terms"),
    )


def labels(df: DataFrame) -> DataFrame:
    return weights(labeling.cluster_labels(df))


def labels_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_source = categorized(spark, sf_dir, "source")
    return weights(labeling.cluster_labels(by_source, num_features=FEATURES))


def nested_labels(df: DataFrame) -> DataFrame:
    return labeling.nest_labels(labeling.cluster_labels(df)).select(
        "cate", F.array_join(F.transform("labels", lambda t: t["term"]), " ").alias("labels")
    )


# --- affinity propagation ---------------------------------------------------


def cosine_edges(df: DataFrame) -> DataFrame:
    return materialize(similarity.cosine_similarity(df), "edges")


def full_affinity_propagation(df: DataFrame) -> DataFrame:
    graph = propagation.auto_preferences(cosine_edges(df))
    return propagation.affinity_propagation(graph, ROUNDS, symmetric=True)


def ap_by(measure: str, preference: float | str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: cluster_documents_ap(
        df, measure, preference, ROUNDS, pruned=True, top_n=NEIGHBORS
    )


def ap_clusters(df: DataFrame) -> DataFrame:
    return listed_members(propagation.cluster_members(ap_by("C", "auto")(df)))


def listed_members(clusters: DataFrame) -> DataFrame:
    members = F.array_join(F.transform("members", lambda m: m.cast("string")), " ")
    return clusters.select("cluster_id", "exemplar", "chunk", members.alias("members"))


def ap_assignments(df: DataFrame) -> DataFrame:
    return propagation.ap_assignments(propagation.cluster_members(ap_by("C", "auto")(df)))


def sweep(report: str) -> Query:
    """The sweep's rows as they stand in the report files."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, gold, tags = gold_standard(spark, sf_dir)
        system, result = ap_topn_sweep(docs(spark, sf_dir), gold, tags, "auto")
        path = scratch_path(spark, "sweep")
        append_sweep_reports(system, result, path)
        columns = result.dtypes if report == "result" else system.drop("chunk").dtypes
        fields = F.split("value", "\t")
        parsed = spark.read.text(f"{path}/{report}").select(
            *[fields[n].cast(kind).alias(name) for n, (name, kind) in enumerate(columns)]
        )
        return parsed.select(
            *[rounded(c, c) if c in evaluation.METRICS else F.col(c) for c in parsed.columns]
        )

    return run


# --- k-means ----------------------------------------------------------------


def hashed_tf(df: DataFrame) -> DataFrame:
    return kmeans.hashed_tf(df)


def idf(df: DataFrame) -> DataFrame:
    weights = kmeans.idf(materialize(kmeans.hashed_tf(df), "hashed"))
    return weights.select("bucket", "df", rounded("idf", "idf"))


def tfidf_vectors(df: DataFrame) -> DataFrame:
    return kmeans.tfidf_vectors(df).withColumn("weight", rounded("weight", "weight"))


def kmeans_assignments(df: DataFrame) -> DataFrame:
    features = materialize(kmeans.tfidf_vectors(df), "features")
    model = kmeans.kmeans(features, k=CENTERS, max_iter=KMEANS_ROUNDS, seed=SEED)
    return kmeans.kmeans_assignments(model, features)


def kmeans_summary(df: DataFrame) -> DataFrame:
    """Clusters of the better of two runs: sizes, and mean squared distance to the center."""
    features = materialize(kmeans.tfidf_vectors(df), "features")
    model = kmeans.kmeans(features, CENTERS, KMEANS_ROUNDS, runs=2, seed=SEED)
    sizes = kmeans.kmeans_assignments(model, features).groupBy("cluster_id")
    cost = kmeans.total_cost(features, model)
    n_docs = features.select("doc_id").distinct().count()
    mean = F.round(F.lit(cost / max(n_docs, 1)), 4).alias("mean_cost")
    return sizes.agg(F.count("*").alias("n_docs")).select("cluster_id", "n_docs", mean)


# --- evaluation -------------------------------------------------------------


def gold_standard(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters by source, gold label by language, every language a tag."""
    table = documents(spark, sf_dir)
    assignments = table.select("doc_id", F.col("source").alias("cluster_id"))
    gold = table.select("doc_id", F.col("lang").alias("label"))
    return assignments, gold, gold.select("label").distinct()


def scored(build: Callable[..., DataFrame], *fractions: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(*gold_standard(spark, sf_dir))
        return df.select(*[rounded(c, c) for c in fractions]) if fractions else df

    return run


def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = evaluation.pair_counts(*gold_standard(spark, sf_dir))
    return counts.select(*[F.col(c).cast("bigint").alias(c) for c in counts.columns])


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold from ``labels.quality``, which covers part of the documents only."""
    assignments, _, _ = gold_standard(spark, sf_dir)
    gold = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", F.col("quality").cast("string").alias("label")
    )
    row = evaluation.evaluate_clusters(assignments, gold, gold.select("label").distinct())
    return row.select(*[rounded(c, c) for c in evaluation.METRICS])


def numbered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.relabel_clusters(gold_standard(spark, sf_dir)[0])


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.cluster_sizes(numbered_sources(spark, sf_dir))


def size_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.size_list(numbered_sources(spark, sf_dir))


def assignment_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.assignment_string(numbered_sources(spark, sf_dir))


# --- sources and sinks ------------------------------------------------------


def one_line(column: str) -> Column:
    return F.regexp_replace(column, LINE_BREAKS, " ")


def read_docs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "doc-lines")
    lines = docs(spark, sf_dir).select(F.concat_ws(" ", "doc_id", one_line("text")))
    lines.write.text(path)
    return read_docs(spark, path)


def read_categorized_docs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "cat-doc-lines")
    lines = cat_docs(spark, sf_dir).select(F.concat_ws(" ", "cate", "doc_id", one_line("text")))
    lines.write.text(path)
    return read_categorized_docs(spark, path, min_partitions=4)


def malformed_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document texts themselves read as ``docid text`` lines."""
    path = scratch_path(spark, "malformed-lines")
    docs(spark, sf_dir).select(one_line("text")).write.text(path)
    return malformed_lines(spark, path).agg(F.count("*").alias("n_lines"))


def read_gold_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold file with one header line per written file."""
    path = scratch_path(spark, "gold")
    gold = documents(spark, sf_dir).select(F.concat_ws(" ", "doc_id", "lang").alias("gold"))
    gold.write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    return read_gold(spark, path)


def read_tags_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tags")
    documents(spark, sf_dir).select("lang").distinct().write.text(path)
    return read_tags(spark, path)


def write_overwrite_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second write replaces the first one wholly."""
    path = scratch_path(spark, "scores")
    write_overwrite(cat_docs(spark, sf_dir).select("doc_id"), path)
    write_overwrite(weighting.term_scores(cat_docs(spark, sf_dir)), path)
    return spark.read.parquet(path).select("term", rounded("lig", "lig"), rounded("ig", "ig"))


def write_by_category_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "category-scores")
    write_by_category(weighting.category_term_scores(cat_docs(spark, sf_dir)), path)
    return spark.read.parquet(path).select(
        F.col("cate").cast("string"), "term", rounded("lig", "lig"), rounded("ig", "ig")
    )


def append_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    for name in ("lang", "source"):
        table = docs_from_table(documents(spark, sf_dir), "doc_id", "text", name)
        append_report(stats.category_size(table), path)
    fields = F.split("value", "\t")
    return spark.read.text(path).select(
        fields[0].alias("cate"), fields[1].cast("bigint").alias("n_docs")
    )


def term_score_job(output: str, weight: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, "term-scores")
        write_term_scores(cat_docs(spark, sf_dir), path)
        df = spark.read.parquet(f"{path}/{output}")
        if weight:
            return weights(df.select("cate", "doc_id", "term", "weight"))
        return df.select("term", rounded("lig", "lig"), rounded("ig", "ig"))

    return run


def vector_job(write: Callable[..., None], *options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, "vectors")
        write(cat_docs(spark, sf_dir), path, *options)
        vectors = spark.read.parquet(path)
        return weights(vectors.select("cate", "doc_id", F.inline("terms")))

    return run


def write_labels_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "labels")
    write_cluster_labels(cat_docs(spark, sf_dir), path)
    return spark.read.parquet(path).select(
        "cate", F.array_join(F.transform("labels", lambda t: t["term"]), " ").alias("labels")
    )


def write_ap_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ap-clusters")
    write_ap_clusters(docs(spark, sf_dir), path, "C", "auto", ROUNDS, top_n=NEIGHBORS)
    return listed_members(spark.read.parquet(path))


def write_kmeans_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "kmeans")
    write_kmeans_assignments(docs(spark, sf_dir), path, CENTERS, KMEANS_ROUNDS, seed=SEED)
    return spark.read.parquet(path)


def all_queries() -> dict[str, Query]:
    return {
        # text
        "normalize_text": over_docs(
            lambda d: d.select("doc_id", normalize_text(F.col("text")).alias("text"))
        ),
        "tokenize_raw": over_docs(positioned(tokenize_raw)),
        "tokenize_filtered": over_docs(positioned(tokenize_filtered)),
        "doc_length": over_docs(stats.doc_length),
        # term statistics
        "term_frequency": over_cat_docs(stats.term_frequency),
        "term_frequency_raw": over_docs(stats.term_frequency_raw),
        "distinct_doc_terms": over_cat_docs(stats.distinct_doc_terms),
        "category_size": over_cat_docs(stats.category_size),
        "corpus_size": over_cat_docs(stats.corpus_size),
        "category_term_df": over_cat_docs(stats.category_term_df),
        "term_df": over_cat_docs(stats.term_df),
        "vocabulary_size": over_docs(stats.vocabulary_size),
        "doc_norm": over_docs(
            lambda d: stats.doc_norm(d).select("doc_id", rounded("norm", "norm"))
        ),
        "posting_lists": over_cat_docs(posting_lists),
        # term weighting
        "lig": over_cat_docs(lambda d: weighting.lig(d).select("term", rounded("lig", "lig"))),
        "ig": over_cat_docs(lambda d: weighting.ig(d).select("term", rounded("ig", "ig"))),
        "term_scores": over_cat_docs(
            lambda d: weighting.term_scores(d).select(
                "term", rounded("lig", "lig"), rounded("ig", "ig")
            )
        ),
        "category_term_scores": over_cat_docs(
            lambda d: weighting.category_term_scores(d).select(
                "cate", "term", rounded("lig", "lig"), rounded("ig", "ig")
            )
        ),
        "tf_icdf": over_cat_docs(lambda d: weights(weighting.tf_icdf(d))),
        "tf_icdf_top_n": over_cat_docs(lambda d: weights(weighting.tf_icdf(d, FEATURES))),
        "tf_lig": over_cat_docs(lambda d: weights(weighting.tf_lig(d))),
        "log_tf_lig": over_cat_docs(lambda d: weights(weighting.log_tf_lig(d))),
        "log_tf_ig": over_cat_docs(lambda d: weights(weighting.log_tf_ig(d))),
        "doc_weight_vectors": over_cat_docs(doc_weight_vectors),
        # cluster labeling
        "select_features_by_lig": over_cat_docs(
            lambda d: labeling.select_features_by_lig(weighting.term_scores(d), FEATURES).select(
                "term", rounded("lig", "lig")
            )
        ),
        "df_lig": over_cat_docs(lambda d: weights(labeling.df_lig(d))),
        "df_lig_selected": over_cat_docs(lambda d: weights(labeling.df_lig(d, FEATURES))),
        "cluster_labels": over_cat_docs(labels),
        "cluster_labels_by_source": labels_by_source,
        "cluster_labels_nested": over_cat_docs(nested_labels),
        # similarity
        "cosine_similarity": over_docs(lambda d: edges(similarity.cosine_similarity(d))),
        "euclidean_similarity": over_docs(lambda d: edges(similarity.euclidean_similarity(d))),
        "frey_similarity": over_docs(
            lambda d: edges(similarity.frey_similarity(d, PREFERENCE))
        ),
        "frey_similarity_auto": over_docs(lambda d: edges(similarity.frey_similarity_auto(d))),
        "cosine_top_n": over_docs(
            lambda d: edges(similarity.cosine_similarity(d, top_n=NEIGHBORS))
        ),
        "euclidean_top_n": over_docs(
            lambda d: edges(similarity.euclidean_similarity(d, top_n=NEIGHBORS))
        ),
        "frey_top_n": over_docs(
            lambda d: edges(similarity.frey_similarity(d, PREFERENCE, top_n=NEIGHBORS))
        ),
        "symmetrize_edges": over_docs(
            lambda d: edges(similarity.symmetrize_edges(similarity.cosine_similarity(d)))
        ),
        # clustering
        "embed_preferences": over_docs(
            # multiplied twice: the edges would take more disk than anything else
            lambda d: edges(propagation.embed_preferences(similarity.cosine_similarity(d), -1.0))
        ),
        "auto_preferences": over_docs(
            # not written, there is nearly one edge per pair: each pass forms the products again
            lambda d: edges(propagation.auto_preferences(similarity.cosine_similarity(d)))
        ),
        "affinity_propagation": over_docs(full_affinity_propagation),
        "cluster_documents_ap_cosine": over_docs(ap_by("C", "auto")),
        "cluster_documents_ap_euclidean": over_docs(ap_by("E", "auto")),
        "cluster_documents_ap_frey": over_docs(ap_by("F", FREY_PREFERENCE)),
        "cluster_documents_ap_frey_auto": over_docs(ap_by("F", "auto")),
        "ap_clusters": over_docs(ap_clusters),
        "ap_assignments": over_docs(ap_assignments),
        "ap_topn_sweep_system": sweep("system"),
        "ap_topn_sweep_result": sweep("result"),
        "hashed_tf": over_docs(hashed_tf),
        "idf": over_docs(idf),
        "tfidf_vectors": over_docs(tfidf_vectors),
        "kmeans": over_docs(kmeans_summary),
        "kmeans_assignments": over_docs(kmeans_assignments),
        # evaluation
        "contingency_table": scored(evaluation.contingency_table),
        "relabel_clusters": numbered_sources,
        "purity": scored(evaluation.purity, "purity"),
        "pair_counts": pair_counts,
        "rand_index": scored(evaluation.rand_index, "rand_index"),
        "pair_precision": scored(evaluation.pair_precision, "precision"),
        "pair_recall": scored(evaluation.pair_recall, "recall"),
        "pair_f1": scored(evaluation.pair_f1, "f1"),
        "nmi": scored(evaluation.nmi, "nmi"),
        "evaluate_clusters": scored(evaluation.evaluate_clusters, *evaluation.METRICS),
        "evaluate_clusters_quality": quality_labels,
        "cluster_sizes": cluster_sizes,
        "size_list": size_list,
        "assignment_string": assignment_string,
        # sources and sinks
        "docs_from_table": cat_docs,
        "read_docs": read_docs_query,
        "read_categorized_docs": read_categorized_docs_query,
        "malformed_lines": malformed_lines_query,
        "read_gold": read_gold_query,
        "read_tags": read_tags_query,
        "write_overwrite": write_overwrite_query,
        "write_by_category": write_by_category_query,
        "append_report": append_report_query,
        "write_term_scores_all": term_score_job("lig_all", weight=False),
        "write_term_scores_tflig": term_score_job("tflig", weight=True),
        "write_term_scores_tfig": term_score_job("tfig", weight=True),
        "write_tf_lig": vector_job(write_tf_lig),
        "write_tf_icdf": vector_job(write_tf_icdf, FEATURES),
        "write_cluster_labels": write_labels_job,
        "write_ap_clusters": write_ap_job,
        "write_kmeans_assignments": write_kmeans_job,
    }
