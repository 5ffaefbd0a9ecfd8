"""Whole clustering jobs: text to clusters, and the top-N sweep with metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doccluster.operators.evaluation import (
    METRICS,
    assignment_string,
    cluster_sizes,
    evaluate_clusters,
    size_list,
)
from doccluster.operators.propagation import (
    affinity_propagation,
    auto_preferences,
    embed_preferences,
    exemplars_of,
)
from doccluster.operators.ranking import dense_position, exact_median
from doccluster.operators.similarity import (
    cosine_similarity,
    euclidean_similarity,
    frey_similarity,
    symmetrize_edges,
)
from doccluster.sources.scratch import materialize
from doccluster.sources.writers import append_report

# --- fixed values -----------------------------------------------------------
# Similarities: F (Frey-Dueck), E (Euclidean), C (cosine).
SIMILARITIES = ("F", "E", "C")
AUTO = "auto"
SWEEP_TAGS = ("all", "10", "50", "100", "200", "300", "500", "1k", "1.5k")
SWEEP_TOP_N = (None, 10, 50, 100, 200, 300, 500, 1000, 1500)
SWEEP_ITERATIONS = 20
# ----------------------------------------------------------------------------


def _with_preferences(edges: DataFrame, preference: float | str) -> DataFrame:
    if preference == AUTO:
        return auto_preferences(edges)
    return embed_preferences(edges, float(preference))


def with_isolated_documents(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Add the documents that no edge reaches, each as a cluster of its own."""
    everyone = materialize(
        docs.select("doc_id")
        .join(clusters.select("doc_id", "exemplar"), "doc_id", "left")
        .select("doc_id", F.coalesce("exemplar", "doc_id").alias("exemplar")),
        "all-documents",
    )
    numbers = dense_position(
        everyone.filter(F.col("doc_id") == F.col("exemplar")).select("exemplar"),
        "exemplar",
        "cluster_id",
    )
    return everyone.join(numbers, "exemplar").select("doc_id", "exemplar", "cluster_id")


def cluster_documents_ap(
    docs: DataFrame,
    similarity: str,
    preference: float | str,
    max_iter: int,
    pruned: bool = False,
    top_n: int | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Documents to ``(doc_id, exemplar, cluster_id)`` by affinity propagation.

    ``similarity`` is C, E or F; ``preference`` a number or ``"auto"`` (the
    median similarity). Pruned graphs and Frey-Dueck graphs are directed.
    Frey-Dueck similarity has a value for every ordered pair of documents, so it
    needs ``pruned`` and ``top_n``, which rank the whole matrix; every document
    keeps its preference besides. Documents without any edge take no part and
    get no cluster.
    """
    if similarity not in SIMILARITIES:
        raise ValueError(f"similarity must be one of {SIMILARITIES}, not {similarity!r}")
    if pruned and top_n is None:
        raise ValueError("a pruned graph needs top_n")
    if similarity == "F" and not pruned:
        raise ValueError("Frey-Dueck similarity relates all pairs: prune it to top_n")
    limit = top_n if pruned else None
    if similarity == "F":
        given = None if preference == AUTO else float(preference)
        edges = frey_similarity(docs, given, limit, num_partitions, keep_self=True)
        edges = materialize(edges, "edges")
        if preference == AUTO:
            edges = auto_preferences(edges)
        return affinity_propagation(edges, max_iter, symmetric=False)
    measure = cosine_similarity if similarity == "C" else euclidean_similarity
    edges = materialize(measure(docs, top_n=limit, num_partitions=num_partitions), "edges")
    return affinity_propagation(
        _with_preferences(edges, preference), max_iter, symmetric=not pruned
    )


def _setting_graphs(edges: DataFrame, settings: range, preference: float | str) -> DataFrame:
    """``(i, k, s)`` with preferences, the graphs of all settings side by side.

    A node is ``(setting, id)``. Every edge is ranked once among those of its
    document; a setting keeps the edges up to its rank.
    """
    limits = {n: SWEEP_TOP_N[n] for n in settings}
    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s"), "k"))
    ranked = symmetrize_edges(edges.filter(F.col("i") != F.col("k"))).withColumn("place", place)
    if None not in limits.values():
        ranked = ranked.filter(F.col("place") <= max(limits.values()))
    chosen = [
        F.lit(n) if limit is None else F.when(F.col("place") <= limit, F.lit(n))
        for n, limit in limits.items()
    ]
    kept = materialize(
        ranked.select(F.explode(F.array_compact(F.array(*chosen))).alias("setting"), "i", "k", "s"),
        "setting-edges",
    )
    own = F.lit(0.0)
    for n in settings:
        value = preference
        if preference == AUTO:
            value = exact_median(kept.filter(F.col("setting") == n), "s")
        own = F.when(F.col("setting") == n, F.lit(float(value or 0.0))).otherwise(own)
    alone = kept.select("setting", "i").distinct().select("setting", "i", F.col("i").alias("k"), own.alias("s"))
    nodes = [F.struct("setting", F.col(c).alias("id")).alias(c) for c in ("i", "k")]
    return kept.unionByName(alone).select(*nodes, "s")


def _sweep_setting(
    docs: DataFrame,
    clusters: DataFrame,
    gold: DataFrame,
    tags: DataFrame,
    category: str,
    setting: int,
) -> tuple[DataFrame, DataFrame]:
    assignments = materialize(
        with_isolated_documents(docs, clusters).select("doc_id", "cluster_id"), "assignments"
    )
    sizes = materialize(size_list(assignments), "sizes")
    # one row of numbers per setting comes to the driver and goes back as literals
    scores = evaluate_clusters(assignments, gold, tags).first()
    head = [
        F.lit(category).alias("category"),
        F.lit(0).alias("first"),
        F.lit(1).alias("last"),
        F.lit(SWEEP_TAGS[setting]).alias("setting"),
        F.lit("DF").alias("df"),
        F.lit("TF").alias("tf"),
        F.lit(cluster_sizes(assignments).count()).cast("bigint").alias("n_clusters"),
        F.col("sizes"),
    ]
    system = (
        assignment_string(assignments)
        .join(sizes, "chunk", "left")
        .select(*head, "assignments", "chunk")
    )
    metrics = [F.lit(scores[m]).cast("double").alias(m) for m in METRICS]
    # the line of a setting holds one number per cluster, from one row per chunk
    in_order = F.array_sort(F.collect_list(F.struct("chunk", "sizes")))
    line = sizes.agg(F.array_join(F.transform(in_order, lambda c: c["sizes"]), "|").alias("sizes"))
    return system, line.select(*head, *metrics)


def ap_topn_sweep(
    docs: DataFrame,
    gold: DataFrame,
    tags: DataFrame,
    preference: float | str = AUTO,
    start: int = 0,
    end: int = len(SWEEP_TAGS) - 1,
    category: str = "all",
    max_iter: int = SWEEP_ITERATIONS,
) -> tuple[DataFrame, DataFrame]:
    """Cluster with each pruning setting and score it: ``(system, result)`` rows.

    Settings ``start`` to ``end`` index SWEEP_TAGS. The similarity edges are
    computed once. ``result`` has one row per setting. The lists of ``system``
    are cut into chunks of document positions, one row each, and carry no
    metrics. ``append_sweep_reports`` writes both.
    """
    edges = materialize(cosine_similarity(docs), "edges")
    last = min(end, len(SWEEP_TAGS) - 1)
    settings = range(start, last + 1)
    chosen = exemplars_of(_setting_graphs(edges, settings, preference), max_iter, symmetric=True)
    parts = []
    for setting in settings:
        clusters = chosen.filter(F.col("doc_id.setting") == setting).select(
            F.col("doc_id.id").alias("doc_id"), F.col("exemplar.id").alias("exemplar")
        )
        parts.append(_sweep_setting(docs, clusters, gold, tags, category, setting))
    systems, results = zip(*parts)
    return reduce(DataFrame.unionByName, systems), reduce(DataFrame.unionByName, results)


def append_sweep_reports(
    system: DataFrame, result: DataFrame, path: str, run: str | None = None
) -> None:
    """Append the sweep's rows to the reports ``system`` (9 columns) and ``result`` (14).

    ``run`` names a job that may be repeated, see ``append_report``.
    """
    append_report(system.drop("chunk"), f"{path}/system", run)
    append_report(result, f"{path}/result", run)
