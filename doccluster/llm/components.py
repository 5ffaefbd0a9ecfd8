"""Connected components by repeated contraction, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccluster.sources.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` that has a smaller neighbour.

    In a round each node points to its smallest neighbour, if that is smaller
    than itself, and the edges are renamed by these pointers. A round keeps
    every component connected and at least halves the length of any path of
    pointers. The edges of a round are distinct and written, and so are its
    pointers, so a lost executor costs one round, and the joins, whose both
    sides are read from files, can be split where a node has many edges.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    edges = materialize(
        edges.filter("a != b").select(larger.alias("a"), smaller.alias("b")).distinct(), "edges"
    )
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        pointers = materialize(
            edges.groupBy("a").agg(F.min("b").alias("to")).withColumnRenamed("a", "at"), "pointers"
        )
        rounds.append(pointers)
        half = materialize(
            edges.join(pointers, edges["a"] == pointers["at"], "left").select(
                F.coalesce("to", "a").alias("a"), "b"
            ),
            "renamed",
        )
        renamed = half.join(pointers, half["b"] == pointers["at"], "left").select(
            "a", F.coalesce("to", "b").alias("b")
        )
        edges = materialize(
            renamed.filter("a != b").select(larger.alias("a"), smaller.alias("b")).distinct(), "edges"
        )
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # a node points in one round only, or in several if others point to it;
    # the first pointer of each node is followed through the later rounds
    found = rounds[0].select(F.col("at").alias("node"), F.col("to").alias("root"))
    for pointers in rounds[1:]:
        moved = found.join(pointers, found["root"] == pointers["at"], "left").select(
            "node", F.coalesce("to", "root").alias("root")
        )
        late = pointers.join(found.select("node"), F.col("at") == F.col("node"), "left_anti")
        found = materialize(
            moved.unionByName(late.select(F.col("at").alias("node"), F.col("to").alias("root"))),
            "roots",
        )
    return found
