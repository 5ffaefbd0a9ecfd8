"""Cluster quality against gold labels, as aggregates.

``assignments`` is ``(doc_id, cluster_id)``, ``gold`` is ``(doc_id, label)``
and ``tags`` lists the labels that count. Sums over document pairs come from
group sizes in closed form and are kept as DECIMAL(38,0), so they hold for
more documents than a 64-bit pair count would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccluster.operators.ranking import dense_position
from doccluster.operators.stats import CHUNK_BITS
from doccluster.sources.scratch import materialize

METRICS = ["purity", "rand_index", "precision", "recall", "f1", "nmi"]


def _tagged(gold: DataFrame, tags: DataFrame) -> DataFrame:
    return gold.join(tags.select("label"), "label", "left_semi")


def contingency_table(assignments: DataFrame, gold: DataFrame, tags: DataFrame) -> DataFrame:
    """``(cluster_id, label, n)``; absent pairs count 0."""
    return (
        assignments.join(_tagged(gold, tags), "doc_id")
        .groupBy("cluster_id", "label")
        .agg(F.count("*").alias("n"))
    )


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    """``(cluster_id, size)``."""
    return assignments.groupBy("cluster_id").agg(F.count("*").alias("size"))


def relabel_clusters(assignments: DataFrame) -> DataFrame:
    """``(doc_id, cluster_id)`` with clusters numbered from 1 by first document."""
    firsts = materialize(
        assignments.groupBy("cluster_id").agg(F.min("doc_id").alias("first")), "first-documents"
    )
    numbers = dense_position(firsts, "first", "position").select(
        "cluster_id", (F.col("position") + 1).alias("number")
    )
    return assignments.join(numbers, "cluster_id").select(
        "doc_id", F.col("number").alias("cluster_id")
    )


def _pairs(n: Column) -> Column:
    wide = n.cast("decimal(19,0)")
    return (wide * (wide - 1) / 2).cast("decimal(38,0)")


def _entropy_term(n: Column, total: Column) -> Column:
    return -(n / total) * F.log(n / total)


class _Tables:
    """The small tables every metric reads: cells, cluster sizes, label totals."""

    def __init__(self, assignments: DataFrame, gold: DataFrame, tags: DataFrame):
        self.cells = materialize(contingency_table(assignments, gold, tags), "contingency")
        self.sizes = materialize(cluster_sizes(assignments), "cluster-sizes")
        self.documents = self.sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        self._gold, self._tags = gold, tags

    def label_totals(self) -> DataFrame:
        return (
            _tagged(self._gold, self._tags).groupBy("label").agg(F.count("*").alias("total"))
        )

    def purity(self) -> DataFrame:
        largest = self.cells.groupBy("cluster_id").agg(F.max("n").alias("largest"))
        return largest.agg(
            F.try_divide(F.coalesce(F.sum("largest"), F.lit(0)), F.lit(self.documents)).alias(
                "purity"
            )
        )

    def pair_counts(self) -> DataFrame:
        zero = F.lit(0).cast("decimal(38,0)")
        together = self.sizes.agg(
            F.struct(
                F.coalesce(F.sum(_pairs(F.col("size"))), zero).alias("same_cluster"),
                F.coalesce(_pairs(F.sum("size")), zero).alias("all_pairs"),
            )
        ).scalar()
        by_label = self.cells.groupBy("label").agg(
            _pairs(F.sum("n")).alias("same_label"), F.sum(_pairs(F.col("n"))).alias("both")
        )
        sums = by_label.agg(
            F.coalesce(F.sum("both"), zero).alias("tp"),
            F.coalesce(F.sum(F.col("same_label") - F.col("both")), zero).alias("fn"),
        ).withColumn("sizes", together)
        fp = F.col("sizes.same_cluster") - F.col("tp")
        tn = F.col("sizes.all_pairs") - F.col("sizes.same_cluster") - F.col("fn")
        return sums.select(
            *[c.cast("decimal(38,0)").alias(name)
              for name, c in (("tp", F.col("tp")), ("fp", fp), ("fn", F.col("fn")), ("tn", tn))]
        )

    def pair_metrics(self) -> DataFrame:
        tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
        precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
        return self.pair_counts().select(
            F.try_divide(tp + tn, tp + fp + fn + tn).alias("rand_index"),
            precision.alias("precision"),
            recall.alias("recall"),
            F.try_divide(2 * precision * recall, precision + recall).alias("f1"),
        )

    def nmi(self) -> DataFrame:
        n = F.lit(float(self.documents))
        totals = self.label_totals()
        share = F.col("n") / n
        mutual = (
            self.cells.join(self.sizes, "cluster_id")
            .join(totals, "label")
            .agg(
                F.sum(share * F.log(n * F.col("n") / F.col("size") / F.col("total"))).alias("mi")
            )
        )
        cluster_entropy = self.sizes.agg(F.sum(_entropy_term(F.col("size"), n))).scalar()
        label_entropy = totals.agg(F.sum(_entropy_term(F.col("total"), n))).scalar()
        return mutual.select(
            F.try_divide(2 * F.col("mi"), F.abs(cluster_entropy + label_entropy)).alias("nmi")
        )

    def all_metrics(self) -> DataFrame:
        return (
            self.pair_metrics()
            .withColumn("purity", self.purity().scalar())
            .withColumn("nmi", self.nmi().scalar())
            .select(*METRICS)
        )


def pair_counts(assignments: DataFrame, gold: DataFrame, tags: DataFrame) -> DataFrame:
    """One row ``(tp, fp, fn, tn)`` over document pairs."""
    return _Tables(assignments, gold, tags).pair_counts()


def purity(assignments: DataFrame, gold: DataFrame, tags: DataFrame) -> DataFrame:
    """Share of documents that carry their cluster's most frequent label."""
    return _Tables(assignments, gold, tags).purity()


def rand_index(assignments: DataFrame, gold: DataFrame, tags: DataFrame) -> DataFrame:
    """(TP + TN) / all pairs."""
    return _Tables(assignments, gold, tags).pair_metrics().select("rand_index")


def pair_precision(assignments: DataFrame, gold: DataFrame, tags: DataFrame) -> DataFrame:
    """TP / (TP + FP)."""
    return _Tables(assignments, gold, tags).pair_metrics().select("precision")


def pair_recall(assignments: DataFrame, gold: DataFrame, tags: DataFrame) -> DataFrame:
    """TP / (TP + FN)."""
    return _Tables(assignments, gold, tags).pair_metrics().select("recall")


def pair_f1(assignments: DataFrame, gold: DataFrame, tags: DataFrame) -> DataFrame:
    """Harmonic mean of pair precision and recall."""
    return _Tables(assignments, gold, tags).pair_metrics().select("f1")


def nmi(assignments: DataFrame, gold: DataFrame, tags: DataFrame) -> DataFrame:
    """2 MI / (H(cluster) + H(label)), natural logarithm.

    Label totals come from all gold rows, cluster totals from the assignments.
    """
    return _Tables(assignments, gold, tags).nmi()


def evaluate_clusters(assignments: DataFrame, gold: DataFrame, tags: DataFrame) -> DataFrame:
    """All six metrics in one row; 0/0 is NULL."""
    return _Tables(assignments, gold, tags).all_metrics()


def _chunked_text(rows: DataFrame, position: str, item: Column, out: str) -> DataFrame:
    """``(chunk, out)``: items joined by ``|`` in order, cut by position range."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(position), item.alias("item"))))
    return rows.groupBy(F.shiftright(position, CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.transform(listed, lambda row: row["item"]), "|").alias(out)
    )


def size_list(assignments: DataFrame) -> DataFrame:
    """``(chunk, sizes)``: cluster sizes in order of cluster id, joined by ``|``."""
    return _chunked_text(
        cluster_sizes(assignments), "cluster_id", F.col("size").cast("string"), "sizes"
    )


def assignment_string(assignments: DataFrame) -> DataFrame:
    """``(chunk, assignments)``: ``index cluster`` pairs joined by ``|``.

    The index is the 0-based position of the document in id order. One string
    per 2^CHUNK_BITS positions; the chunks in order are the whole list.
    """
    placed = dense_position(assignments, "doc_id", "position")
    item = F.concat_ws(" ", F.col("position"), F.col("cluster_id"))
    return _chunked_text(placed, "position", item, "assignments")
