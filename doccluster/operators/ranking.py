"""Order statistics: best rows per key, and global ones that never hold a whole column in one task."""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doccluster.sources.scratch import materialize

# Rows per chunk that dense_position aims for; one task sees the chunk totals only.
CHUNK_ROWS = 65536
# Values that exact_median may fetch for its last step.
SMALL_ENOUGH = 50_000
# Relative rank error of percentile_approx is 1 / ACCURACY.
ACCURACY = 10_000
# How far to each side of a rank a bracket reaches, as a share of the rows.
MARGIN = 1.5 / ACCURACY
# Parts that written values are cut into to narrow a bracket further.
PARTS = 32


def dense_position(df: DataFrame, id_col: str, out: str) -> DataFrame:
    """Add ``out``: the 0-based rank of the unique ``id_col`` over the whole table.

    Ids fall into ranges whose borders Spark measures, so ranges are of like
    size however the ids are spread. Rows are numbered inside their range, and a
    running total of the range sizes (one row per range, about one per
    CHUNK_ROWS ids) gives each range its offset.
    """
    ranges = max(1, -(-df.count() // CHUNK_ROWS))
    # written, as the borders are measured anew each time the plan runs
    ranged = materialize(
        df.repartitionByRange(ranges, id_col).withColumn("_range", F.spark_partition_id()), "ranged"
    )
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_range").orderBy(id_col)
    return (
        ranged.withColumn("_row", F.row_number().over(inside) - 1)
        .join(offsets, "_range")
        .withColumn(out, F.col("_offset") + F.col("_row"))
        .select(*df.columns, out)
    )


def _inside(cells: DataFrame, low: float, high: float) -> tuple[DataFrame, int, int, int]:
    """Written ``(v, n)`` of the values from ``low`` to ``high``, one row each; how many
    values are below, how many inside, and how many rows that is. Reads ``cells`` once."""
    v = F.col("v")
    place = F.when(v < low, -1).when(v > high, 1).otherwise(0)
    counted = materialize(
        cells.groupBy(place.alias("place"), F.when(place == 0, v).alias("v")).agg(
            F.sum("n").alias("n")
        ),
        "bracket",
    )
    found = {
        row.place: row
        for row in counted.groupBy("place").agg(F.sum("n").alias("n"), F.count("*").alias("r")).collect()
    }
    below, inside = (found[p].n if p in found else 0 for p in (-1, 0))
    rows = found[0].r if 0 in found else 0
    return counted.filter("place = 0").select("v", "n"), below, inside, rows


def _ends(cells: DataFrame, ranks: list[int]) -> list[float]:
    """A bracket that holds the ``ranks``: the rows are cut into even parts and counted."""
    shares = [n / PARTS for n in range(PARTS + 1)]
    cuts = cells.agg(F.percentile_approx("v", shares, ACCURACY)).first()[0]
    # the least and the largest value are cuts, so that no value is left out
    row = cells.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    cuts = [row.low, *cuts[1:-1], row.high]
    upto = cells.agg(
        *[F.sum(F.when(F.col("v") <= cut, F.col("n")).otherwise(0)) for cut in cuts]
    ).first()
    first, last = (bisect.bisect_right(upto, rank) for rank in (ranks[0], ranks[-1]))
    return [cuts[max(first - 1, 0)], cuts[last]]


def _at_ranks(
    cells: DataFrame, rows: int, ranks: list[int], ends: list[float] | None = None
) -> list[float]:
    """The values at 0-based neighbouring ``ranks`` of ``rows`` rows ``(v, n)``.

    ``ends`` is a bracket that may hold them; what is inside it is written for the next step.
    """
    if rows <= SMALL_ENOUGH:
        values = sorted((row.v, row.n) for row in cells.collect())
        upto = list(itertools.accumulate(n for _, n in values))
        return [values[bisect.bisect_right(upto, rank)][0] for rank in ranks]
    inner, below, inside, left = _inside(cells, *(ends or _ends(cells, ranks)))
    if ranks[0] < below or ranks[-1] >= below + inside:
        # the sketch has missed them
        return _at_ranks(cells, rows, ranks)
    # a few values may have no cut between them
    return _at_ranks(inner, 0 if left <= PARTS else left, [rank - below for rank in ranks])


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median of a column; the mean of the middle two for an even count.

    Reads the column twice, unless a sketch misses: once to count it and bracket
    the median, once to count what lies below and inside the bracket. A column too
    large to write is formed anew each time.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    size, ends = values.agg(
        F.count("*"), F.percentile_approx("v", [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY)
    ).first()
    if size == 0:
        return None
    cells = values.withColumn("n", F.lit(1).cast("bigint"))
    ranks = sorted({(size - 1) // 2, size // 2})
    middle = _at_ranks(cells, size, ranks, ends)
    return sum(middle) / len(middle)


def top_n_neighbors(edges: DataFrame, n: int) -> DataFrame:
    """Per ``i`` the ``n`` edges with the largest ``s``, ties by ``k``.

    The rank limit runs before the shuffle too, so a document sends at most
    ``n`` edges per task.
    """
    best = Window.partitionBy("i").orderBy(F.desc("s"), "k")
    return (
        edges.withColumn("_rank", F.row_number().over(best))
        .filter(F.col("_rank") <= n)
        .select("i", "k", "s")
    )
