"""k-means over hashed TF-IDF vectors, as joins and aggregates of sparse rows.

A vector is its rows ``(doc_id, bucket, weight)``; a document without tokens
has one row without a bucket. Centers are rows ``(bucket, center)`` with one
weight per cluster. For the rounds documents are packed into rows of arrays, once. A round
reads them in one pass: a task assigns its documents and adds them up per
cluster and bucket, and only these sums are shuffled, so a round shuffles no
more for a larger table. Centers above BROADCAST_WEIGHTS are joined by bucket
instead. No document is ever dense.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccluster.functions.text import tokenize_raw, with_bag
from doccluster.sources.scratch import materialize, scratch_path, write_scratch

# --- fixed values -----------------------------------------------------------
NUM_FEATURES = 1 << 20
RUNS = 1
# ----------------------------------------------------------------------------
# Costs that agree to this many digits are ties; the smaller cluster id wins.
TIE_DIGITS = 6
# Weights of all centers up to which they may be broadcast, 8 bytes each.
BROADCAST_WEIGHTS = 1 << 23
# Tasks of a round per core; each hands over at most one row per bucket.
TASKS_PER_CORE = 2
# Documents packed as one row, and such rows in a file; the types of their numbers.
PACKED_DOCS, FILE_ROWS = 1000, 16
PACKED = {
    "marks": "int64",
    "sizes": "int32",
    "squares": "float64",
    "buckets": "int32",
    "weights": "float64",
}


def hash_bucket(token: Column, num_features: int) -> Column:
    """The bucket of a term: the first 32 bits of its MD5, modulo ``num_features``."""
    head = F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10)
    return F.pmod(head.cast("bigint"), F.lit(num_features)).cast("int")


def hashed_tf(docs: DataFrame, num_features: int = NUM_FEATURES) -> DataFrame:
    """``(doc_id, bucket, tf)``: hashed term frequencies of raw tokens, without a shuffle.

    Terms of one bucket are merged. A document without tokens has one row with
    null bucket and tf.
    """
    buckets = F.transform(
        tokenize_raw(F.col("text")), lambda t: hash_bucket(t, num_features).cast("string")
    )
    bags = with_bag(docs, buckets, "doc_id")
    return bags.select("doc_id", F.inline_outer(F.arrays_zip("terms", "counts"))).select(
        "doc_id", F.col("terms").cast("int").alias("bucket"), F.col("counts").alias("tf")
    )


def idf(vectors: DataFrame) -> DataFrame:
    """``(bucket, df, idf)`` of ``hashed_tf``: ``ln((N + 1) / (df + 1))``.

    N counts every document, also those without tokens.
    """
    total = vectors.select("doc_id").distinct().count()
    df = vectors.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log((F.lit(total) + 1) / (F.col("df") + 1)))


def tfidf_vectors(docs: DataFrame, num_features: int = NUM_FEATURES) -> DataFrame:
    """``(doc_id, bucket, weight)``: hashed term frequencies rescaled by their idf."""
    vectors = materialize(hashed_tf(docs, num_features), "hashed-tf")
    weights = idf(vectors).select("bucket", "idf")
    # one row per bucket, of which there are num_features
    if num_features <= BROADCAST_WEIGHTS:
        weights = F.broadcast(weights)
    return vectors.join(weights, "bucket", "left").select(
        "doc_id", "bucket", (F.col("tf") * F.col("idf")).alias("weight")
    )


@dataclass
class Centers:
    """``centers`` is ``(bucket, center)``, ``norms`` each center's squared length."""

    centers: DataFrame
    norms: list[float]
    broadcast: bool


def _start_order(seed: int, run: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.lit(run), "doc_id").cast("binary"))


def _first_assignments(features: DataFrame, k: int, seed: int, run: int) -> DataFrame:
    """The k documents whose hashed ids are least, each a cluster of its own."""
    ids = features.select("doc_id").distinct()
    first = ids.orderBy(_start_order(seed, run), "doc_id").limit(k).collect()
    rows = [(row.doc_id, n) for n, row in enumerate(first)]
    return features.sparkSession.createDataFrame(rows, "doc_id bigint, cluster_id bigint")


def _cluster_facts(assigned: DataFrame, k: int) -> tuple[list[int], list[int]]:
    """Sizes of the k clusters, and a number for each that its documents give in any order."""
    members = F.bit_xor(F.xxhash64("doc_id")).alias("members")
    sizes, marks = [0] * k, [0] * k
    for row in assigned.groupBy("cluster_id").agg(F.count("*").alias("n"), members).collect():
        sizes[row.cluster_id], marks[row.cluster_id] = row.n, row.members
    return sizes, marks


def _new_centers(
    features: DataFrame,
    assigned: DataFrame,
    sizes: list[int],
    num_features: int,
    old: Centers | None = None,
) -> Centers:
    """Means of the clusters' vectors; a cluster without documents keeps its center."""
    weight = F.col("weight")
    sums = [
        F.sum(F.when(F.col("cluster_id") == j, weight).otherwise(0.0)) for j in range(len(sizes))
    ]
    held = features.filter("bucket IS NOT NULL").join(assigned.select("doc_id", "cluster_id"), "doc_id")
    return _means(held.groupBy("bucket").agg(F.array(*sums).alias("sums")), sizes, num_features, old)


def _means(
    centers: DataFrame, sizes: list[int], num_features: int, old: Centers | None = None
) -> Centers:
    """Centers of ``(bucket, sums)``."""
    k = len(sizes)
    # an array of constants keeps the generated code the same from round to round
    number = F.array(*[F.lit(float(max(n, 1))) for n in sizes])
    mean = F.zip_with("sums", number, lambda total, n: total / n)
    centers = centers.select("bucket", mean.alias("center"))
    if old is not None and 0 in sizes:
        before = old.centers.withColumnRenamed("center", "before")
        kept = [
            F.coalesce(F.col("center" if n else "before")[j], F.lit(0.0))
            for j, n in enumerate(sizes)
        ]
        centers = centers.join(before, "bucket", "full").select(
            "bucket", F.array(*kept).alias("center")
        )
    centers = materialize(centers, "centers")
    squares = [F.coalesce(F.sum(F.col("center")[j] ** 2), F.lit(0.0)) for j in range(k)]
    return Centers(centers, list(centers.agg(*squares).first()), k * num_features <= BROADCAST_WEIGHTS)


def _assigned(features: DataFrame, model: Centers) -> DataFrame:
    """``(doc_id, cluster_id, cost)``: each document's nearest center and its squared distance."""
    centers = F.broadcast(model.centers) if model.broadcast else model.centers
    weight = F.col("weight")
    dots = [
        F.coalesce(F.sum(weight * F.col("center")[j]), F.lit(0.0)).alias(f"dot_{j}")
        for j in range(len(model.norms))
    ]
    square = F.coalesce(F.sum(weight * weight), F.lit(0.0)).alias("square")
    sums = features.join(centers, "bucket", "left").groupBy("doc_id").agg(square, *dots)
    norms = F.array(*[F.lit(norm) for norm in model.norms])

    def cost(dot: Column, cluster: Column) -> Column:
        squared = F.col("square") - 2 * dot + F.element_at(norms, cluster + 1)
        return F.struct(
            F.round(squared, TIE_DIGITS).alias("cost"), cluster.cast("bigint").alias("cluster_id")
        )

    columns = F.array(*[f"dot_{j}" for j in range(len(model.norms))])
    best = F.array_min(F.transform(columns, cost)).alias("best")
    return sums.select("doc_id", best).select("doc_id", "best.cluster_id", "best.cost")


def _packed_documents(features: DataFrame) -> DataFrame:
    """Written ``(marks, sizes, squares, buckets, weights)``, some documents a row, as bytes."""
    held = F.when(F.col("bucket").isNotNull(), F.struct("bucket", "weight"))
    rows = features.groupBy("doc_id").agg(F.collect_list(held).alias("held"))
    rows = rows.select(
        F.xxhash64("doc_id").alias("mark"),
        F.col("held.bucket").alias("buckets"),
        F.col("held.weight").alias("weights"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PACKED_DOCS):
                batch = whole.slice(start, PACKED_DOCS)
                sizes = np.diff(batch.column("buckets").offsets.to_numpy())
                bucket = batch.column("buckets").flatten().to_numpy()
                weight = batch.column("weights").flatten().to_numpy()
                doc = np.repeat(np.arange(batch.num_rows), sizes)
                square = np.bincount(doc, weights=weight * weight, minlength=batch.num_rows)
                mark = batch.column("mark").to_numpy()
                columns = dict(zip(PACKED, (mark, sizes, square, bucket, weight)))
                row = [pa.array([columns[c].astype(PACKED[c]).tobytes()]) for c in PACKED]
                yield pa.RecordBatch.from_arrays(row, names=list(PACKED))

    packed = rows.mapInArrow(pack, ", ".join(f"{c} binary" for c in PACKED))
    path = scratch_path(features.sparkSession, "packed-documents")
    return write_scratch(packed, path, maxRecordsPerFile=FILE_ROWS)


def _dense(model: Centers, num_features: int) -> np.ndarray:
    """Centers as an array of a row per bucket, of BROADCAST_WEIGHTS numbers at most."""
    table = model.centers.toArrow()
    dense = np.zeros((num_features, len(model.norms)))
    if table.num_rows:
        weights = table["center"].combine_chunks().flatten().to_numpy()
        dense[table["bucket"].to_numpy()] = weights.reshape(table.num_rows, -1)
    return dense


def _round(rows: DataFrame, model: Centers, num_features: int) -> tuple[DataFrame, tuple]:
    """``(bucket, sums)`` of the documents nearest to each center, and ``_cluster_facts``."""
    k, spark = len(model.norms), rows.sparkSession
    shared = spark.sparkContext.broadcast(_dense(model, num_features))
    norms = np.array(model.norms)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, sums = shared.value, np.zeros((num_features, k))
        sizes, marks = np.zeros(k, dtype="int64"), np.zeros(k, dtype="int64")
        for batch in batches:
            for n in range(batch.num_rows):
                mark, size, square, bucket, weight = (
                    np.frombuffer(batch.column(c)[n].as_buffer(), kind) for c, kind in PACKED.items()
                )
                dots = np.zeros((len(size), k))
                if len(bucket):
                    first = (np.cumsum(size) - size)[size > 0]
                    dots[size > 0] = np.add.reduceat(centers[bucket] * weight[:, None], first)
                costs = np.round(square[:, None] - 2 * dots + norms, TIE_DIGITS)
                nearest = np.argmin(costs, axis=1)
                sizes += np.bincount(nearest, minlength=k)
                np.bitwise_xor.at(marks, nearest, mark)
                np.add.at(sums.reshape(-1), bucket.astype("int64") * k + np.repeat(nearest, size), weight)
        used = np.flatnonzero((sums != 0).any(axis=1))
        # the row of the facts comes last and has no bucket
        names = ["bucket", *[f"s{j}" for j in range(k)], *[f"n{j}" for j in range(k)], *[f"m{j}" for j in range(k)]]
        none = pa.nulls(len(used), pa.int64())
        columns = [pa.array(used, pa.int64()), *[pa.array(sums[used, j]) for j in range(k)]]
        yield pa.RecordBatch.from_arrays(columns + [none] * (2 * k), names=names)
        facts = [pa.nulls(1, pa.int64())] + [pa.nulls(1, pa.float64())] * k
        facts += [pa.array([n], pa.int64()) for n in [*sizes.tolist(), *marks.tolist()]]
        yield pa.RecordBatch.from_arrays(facts, names=names)

    kinds = [("s", "double"), ("n", "bigint"), ("m", "bigint")]
    schema = ", ".join(["bucket bigint", *[f"{c}{j} {kind}" for c, kind in kinds for j in range(k)]])
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    parts = rows.coalesce(tasks).mapInArrow(add_up, schema)
    totals = [f(f"{c}{j}").alias(f"{c}{j}") for c, f in zip("snm", (F.sum, F.sum, F.bit_xor)) for j in range(k)]
    added = materialize(parts.groupBy("bucket").agg(*totals), "round")
    shared.unpersist()
    facts = added.filter("bucket IS NULL").first()
    sums = added.filter("bucket IS NOT NULL").select(
        F.col("bucket").cast("int").alias("bucket"), F.array(*[f"s{j}" for j in range(k)]).alias("sums")
    )
    return sums, ([facts[f"n{j}"] for j in range(k)], [facts[f"m{j}"] for j in range(k)])


def kmeans(
    features: DataFrame,
    k: int,
    max_iter: int,
    runs: int = RUNS,
    seed: int = 0,
    num_features: int = NUM_FEATURES,
) -> Centers:
    """Centers of the best of ``runs`` runs by total cost, after ``max_iter`` rounds at most.

    ``features`` is a written ``(doc_id, bucket, weight)``. A run starts from the
    documents whose hashed ids are least for its seed, and ends when no document
    changes its cluster. With fewer documents than ``k`` there are fewer clusters.
    """
    best, least = None, None
    rows = _packed_documents(features) if k * num_features <= BROADCAST_WEIGHTS else None
    for run in range(runs):
        first = _first_assignments(features, k, seed, run)
        found = first.count()
        if not found:
            return Centers(features.selectExpr("bucket", "array() AS center").limit(0), [], True)
        model, seen = _new_centers(features, first, [1] * found, num_features), None
        for _ in range(max_iter):
            if rows is not None:
                sums, facts = _round(rows, model, num_features)
            else:
                assigned = materialize(_assigned(features, model), "assigned")
                facts = _cluster_facts(assigned, found)
            if facts == seen:
                break
            if rows is not None:
                model = _means(sums, facts[0], num_features, model)
            else:
                model = _new_centers(features, assigned, facts[0], num_features, model)
            seen = facts
        if runs == 1:
            return model
        cost = total_cost(features, model)
        if least is None or cost < least:
            best, least = model, cost
    return best


def total_cost(features: DataFrame, model: Centers) -> float:
    """Sum of all documents' squared distances to their nearest centers."""
    return _assigned(features, model).agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]


def kmeans_assignments(model: Centers, features: DataFrame) -> DataFrame:
    """``(doc_id, cluster_id)``."""
    if not model.norms:
        return features.selectExpr("doc_id", "CAST(NULL AS BIGINT) AS cluster_id").limit(0)
    return _assigned(features, model).select("doc_id", "cluster_id")
