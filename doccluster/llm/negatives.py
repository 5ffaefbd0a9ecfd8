"""Hard negatives by a vertical scan with bounds (BOND).

Vectors become whole numbers and are stored in blocks, dimension by dimension,
with each dimension's least and greatest value. A tile is one block and some
anchors. An anchor reads the block's columns in the order of its own largest
components; what the unread ones can still add, at least and at most, bounds
every candidate's score, and the candidates that cannot be in a result any more
leave the bitmap before the next columns are read.

The first pass over the tiles finds each anchor's positives. The second finds,
for each positive, the best rows of other labels within its window of scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doccluster.sources.scratch import materialize

# --- fixed values -----------------------------------------------------------
SCALE = 256
POSITIVES = 5
NEGATIVES = 10
# 30 * positive score <= 100 * negative score <= 90 * positive score
LOW, HIGH, WHOLE = 30, 90, 100
# ----------------------------------------------------------------------------
# Vectors of a block and anchors of a tile, on average.
BLOCK_ROWS = 16_384
TILE_ANCHORS = 1024
# Columns read between two looks at the bounds.
STEP = 8
# Squared length of a scaled vector from which bounds times WHOLE may not fit 64 bits.
LONGEST = float(1 << 48)
MOST_DIMENSIONS = 1 << 14


# --- scanning -----------------------------------------------------------------


class Block:
    """Some vectors, column by column, sorted by label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray) -> None:
        self.ids, self.labels, self.columns = ids, labels, columns
        self.least, self.greatest = columns.min(axis=1), columns.max(axis=1)

    def with_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def scan(
    block: Block, anchor: np.ndarray, alive: np.ndarray, prune: Callable[..., np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Places of the candidates that ``prune`` lets live to the end, and their exact scores.

    ``alive`` is the bitmap of candidates. ``prune(least, most)`` says which of
    the living can still be part of the result, by the bounds of their scores.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * block.least, anchor * block.greatest])[:, order]
    # what the columns from here on add, at least and at most
    rest_least = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
    rest_most = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
    at = np.flatnonzero(alive)
    partial = np.zeros(len(at), np.int64)
    for read in range(0, len(order), STEP):
        if not len(at):
            break
        for dimension in order[read : read + STEP]:
            partial += anchor[dimension] * block.columns[dimension, at]
        done = min(read + STEP, len(order))
        lives = prune(partial + rest_least[done], partial + rest_most[done])
        if not lives.all():
            at, partial = at[lives], partial[lives]
    return at, partial


def _kth_largest(values: np.ndarray, k: int) -> int | None:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def _best(ids: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:count]


def nearest_of_label(
    block: Block, anchor_id: int, label: int, anchor: np.ndarray, count: int
) -> tuple[np.ndarray, np.ndarray]:
    """The best ``count`` other rows of the anchor's label in this block: ids and scores."""
    alive = np.zeros(len(block.ids), bool)
    alive[block.with_label(label)] = True
    alive &= block.ids != anchor_id

    def prune(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        bar = _kth_largest(least, count)
        return np.ones(len(most), bool) if bar is None else most >= bar

    at, scores = scan(block, anchor, alive, prune)
    best = _best(block.ids[at], scores, count)
    return block.ids[at][best], scores[best]


def in_windows(
    block: Block, label: int, anchor: np.ndarray, windows: np.ndarray, count: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window the best ``count`` rows of other labels within it: number, ids, scores.

    ``windows`` has one row ``(low, high)`` each, in units of score times WHOLE.
    """
    alive = np.ones(len(block.ids), bool)
    alive[block.with_label(label)] = False

    def prune(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        lives = np.zeros(len(least), bool)
        for low, high in windows:
            possible = (most * WHOLE >= low) & (least * WHOLE <= high)
            # rows that are surely within the window push out those below them
            bar = _kth_largest(least[(least * WHOLE >= low) & (most * WHOLE <= high)], count)
            lives |= possible if bar is None else possible & (most >= bar)
        return lives

    at, scores = scan(block, anchor, alive, prune)
    for number, (low, high) in enumerate(windows):
        inside = np.flatnonzero((scores * WHOLE >= low) & (scores * WHOLE <= high))
        best = inside[_best(block.ids[at][inside], scores[inside], count)]
        yield number, block.ids[at][best], scores[best]


# --- tables -------------------------------------------------------------------


def whole_vectors(
    table: DataFrame, id_col: str, vector_col: str, label_col: str, moved: Column | None
) -> DataFrame:
    """Written ``(vec_id, label, vector, dims)`` of the rows that take part.

    Left out are rows with a null id, label or vector, with any null or
    non-finite component, with no component or more than MOST_DIMENSIONS, and
    vectors of length 65,536 or more, whose scores might not fit 64 bits. Rows
    that share an id count as one, the one with the least label and vector.
    """
    number = F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))

    def with_square(total: Column, x: Column) -> Column:
        return total + F.pow(F.abs(x.cast("double")) * SCALE + 1, 2)

    # not true either where a component is null, NaN or infinite
    fits = F.aggregate("vector", F.lit(0.0), with_square) < LONGEST
    picked = table.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.col(label_col).cast("bigint").alias("label"),
        F.col(vector_col).alias("vector"),
    ).filter(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.size("vector").between(1, MOST_DIMENSIONS)
        & fits
    )
    label = F.col("label")
    if moved is not None:
        label = F.when(moved, (label + 1) % 10).otherwise(label)
    one = picked.select("vec_id", label.alias("label"), number.alias("vector"))
    row = F.min(F.struct("label", "vector")).alias("row")
    one = one.groupBy("vec_id").agg(row).select("vec_id", "row.label", "row.vector")
    return materialize(one.withColumn("dims", F.size("vector")), "whole-vectors")


BLOCKS = "dims int, block long, ids binary, labels binary, columns binary"


def column_blocks(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Written blocks of vectors column by column, and ``(dims, blocks)``, their numbers.

    Vectors of one length share blocks; ``(dims, blocks)`` has no more rows than
    there are lengths, MOST_DIMENSIONS at most.
    """
    numbers = materialize(
        vectors.groupBy("dims").agg(F.ceil(F.count("*") / block_rows).alias("blocks")), "blocks-of"
    )

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "vec_id"])
        columns = np.stack(pdf["vector"].to_numpy()).T.astype(np.int32)
        return pd.DataFrame(
            {
                "dims": [np.int32(len(columns))],
                "block": [pdf["block"].iloc[0]],
                "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
                "labels": [pdf["label"].to_numpy(np.int64).tobytes()],
                "columns": [np.ascontiguousarray(columns).tobytes()],
            }
        )

    placed = vectors.join(F.broadcast(numbers), "dims").withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), "blocks")
    )
    blocks = placed.groupBy("dims", "block").applyInPandas(build, BLOCKS)
    return materialize(blocks, "blocks"), numbers


def _block(row: pd.Series) -> Block:
    columns = np.frombuffer(row["columns"], np.int32).reshape(row["dims"], -1)
    return Block(
        np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), columns
    )


def _tiles(
    blocks: DataFrame,
    numbers: DataFrame,
    anchors: DataFrame,
    work: Callable[[Block, pd.Series], Iterator[tuple]],
    schema: str,
    tile_anchors: int,
) -> DataFrame:
    """Rows of ``work(block, anchor)`` for every anchor and every block of its length.

    An anchor goes to each block, a block to each part of the anchors: a tile
    has a bounded number of either.
    """
    parts = max(1, -(-anchors.count() // tile_anchors))
    number = F.broadcast(numbers)
    sent = anchors.join(number, "dims").select(
        *anchors.columns,
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"),
    )
    copies = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    copies = copies.withColumn("part", F.col("part").cast("bigint"))
    names = [field.split()[0] for field in schema.split(", ")]

    def tile(block: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(block) and len(some):
            held = _block(block.iloc[0])
            for _, anchor in some.iterrows():
                found += work(held, anchor)
        return pd.DataFrame(found, columns=names)

    keys = ("dims", "block", "part")
    return copies.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(tile, schema)


def _ranked(found: DataFrame, by: tuple[str, ...], score: str, tie: str, count: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= count)


def hard_negatives(
    table: DataFrame,
    is_anchor: Column,
    moved: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    block_rows: int = BLOCK_ROWS,
    tile_anchors: int = TILE_ANCHORS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor`` and ``moved`` are conditions over ``vec_id``; a moved row's
    label first becomes ``(label + 1) % 10``. Components become
    ``floor(256 * x)``, a score is the whole inner product, higher is nearer,
    ties go to the smaller id. An anchor's positives are its best other rows of
    its label; a positive's negatives the best rows of other labels whose score
    lies between 30 and 90 hundredths of the positive's. A negative positive
    score has an empty window. Vectors of different lengths are never compared.
    See ``whole_vectors`` for nulls, repeated ids and rows left out; an empty
    table gives an empty result.
    """
    vectors = whole_vectors(table, id_col, vector_col, label_col, moved)
    blocks, numbers = column_blocks(vectors, block_rows)
    anchors = materialize(vectors.filter(is_anchor), "anchors")

    def positives_of(block: Block, anchor: pd.Series) -> list[tuple]:
        vector = np.asarray(anchor["vector"], np.int64)
        ids, scores = nearest_of_label(
            block, anchor["vec_id"], anchor["label"], vector, positives
        )
        return [(anchor["vec_id"], int(i), int(s)) for i, s in zip(ids, scores)]

    schema = "vec_id long, positive_id long, positive_score long"
    found = _tiles(blocks, numbers, anchors, positives_of, schema, tile_anchors)
    best = materialize(
        _ranked(found, ("vec_id",), "positive_score", "positive_id", positives), "positives"
    )
    pair = F.struct("rank", "positive_id", "positive_score")
    windows = best.groupBy("vec_id").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    windows = windows.select(
        "vec_id",
        F.transform("pairs", lambda p: p["positive_id"]).alias("positive_ids"),
        F.transform("pairs", lambda p: p["positive_score"]).alias("positive_scores"),
    )

    def negatives_of(block: Block, anchor: pd.Series) -> list[tuple]:
        vector = np.asarray(anchor["vector"], np.int64)
        scores = np.asarray(anchor["positive_scores"], np.int64)
        limits = np.stack([scores * LOW, scores * HIGH], axis=1)
        return [
            (anchor["vec_id"], int(anchor["positive_ids"][n]), int(scores[n]), int(i), int(s))
            for n, ids, near in in_windows(block, anchor["label"], vector, limits, negatives)
            for i, s in zip(ids, near)
        ]

    schema = (
        "anchor_id long, positive_id long, positive_score long, negative_id long,"
        " negative_score long"
    )
    near = _tiles(
        blocks, numbers, anchors.join(windows, "vec_id"), negatives_of, schema, tile_anchors
    )
    ranked = _ranked(near, ("anchor_id", "positive_id"), "negative_score", "negative_id", negatives)
    return ranked.select(
        *("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding among all of them."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives(table, F.col("vec_id") % 100 == 0, F.col("vec_id") % 7 == 0)


OP13_SQL = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
), whole AS (
    SELECT vec_id, label, d, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM rows
), scores AS (
    SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same,
           CAST(sum(a.x * o.x) AS BIGINT) AS score
    FROM whole a JOIN whole o ON a.d = o.d AND a.vec_id <> o.vec_id
    WHERE a.vec_id % 100 = 0
    GROUP BY a.vec_id, o.vec_id, a.label = o.label
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (
           PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same
WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (
    PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
