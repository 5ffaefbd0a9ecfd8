import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from check import compare, connect
from doccluster.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, block int"


def brute_force(rows, is_anchor, moved, positives=5, count=10):
    """Hard negatives by whole loops over plain rows."""
    vectors = {}
    for vec_id, vector, label in sorted((r for r in rows if r[0] is not None), key=repr):
        if label is None or vector is None or not vector:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if moved(vec_id) else label
        row = (label, [math.floor(256 * float(np.float32(x))) for x in vector])
        vectors[vec_id] = min(vectors.get(vec_id, row), row)
    out = []
    for anchor, (label, vector) in vectors.items():
        if not is_anchor(anchor):
            continue
        scored = [
            (-sum(x * y for x, y in zip(vector, other)), vec_id, its)
            for vec_id, (its, other) in vectors.items()
            if vec_id != anchor and len(other) == len(vector)
        ]
        scored.sort()
        for negated, positive, _ in [s for s in scored if s[2] == label][:positives]:
            near = [
                (vec_id, -s)
                for s, vec_id, its in scored
                if its != label and -30 * negated <= -100 * s <= -90 * negated
            ]
            out += [
                (anchor, positive, n, vec_id, -negated, s)
                for n, (vec_id, s) in enumerate(near[:count], 1)
            ]
    return sorted(out)


def found_by_op(table, **options):
    found = negatives.hard_negatives(
        table, F.col("vec_id") % 4 == 0, F.col("vec_id") % 7 == 0, **options
    )
    return sorted(map(tuple, found.collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    centers = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    out = []
    for n in range(240):
        center = centers[n % 4]
        out.append((n, [x + rng.gauss(0, 0.7) for x in center], rng.choice([0, 0, 0, 1, 9])))
    same = out[8][1]
    out += [(n, same, n % 3) for n in range(300, 330)]  # ties
    out += [(8, same, 0), (8, same, 0), (9, [0.0] * 12, 1)]  # repeated ids
    out += [(400, [0.0] * 12, 0), (404, [-x for x in same], 0)]
    out += [(408, None, 0), (412, same, None), (None, same, 0), (416, [], 0)]
    out += [(420, [math.nan] * 12, 0), (424, [math.inf] + same[1:], 0), (428, [None] + same[1:], 1)]
    out += [(n, same[:5], n % 2) for n in range(500, 520)]  # another length
    return out


@pytest.mark.parametrize("block_rows,tile_anchors", [(10**6, 10**6), (40, 16), (7, 3)])
def test_like_brute_force_in_tiles_of_any_size(spark, rows, block_rows, tile_anchors):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    expected = brute_force(rows, lambda n: n % 4 == 0, lambda n: n % 7 == 0)
    assert len(expected) > 500
    assert found_by_op(table, block_rows=block_rows, tile_anchors=tile_anchors) == expected


def test_bounds_shrink_the_bitmap_and_keep_scores_exact():
    rng = np.random.default_rng(0)
    scale = np.r_[np.full(4, 400), np.full(60, 3)]  # few columns carry the scores
    vectors = (rng.normal(size=(2000, 64)) * scale).astype(np.int32)
    block = negatives.Block(np.arange(2000), np.zeros(2000, np.int64), vectors.T.copy())
    anchor = vectors[7].astype(np.int64)
    seen = []

    def prune(least, most):
        assert (least <= most).all()
        lives = most >= np.partition(least, -5)[-5]
        seen.append(int(lives.sum()))
        return lives

    at, scores = negatives.scan(block, anchor, np.ones(2000, bool), prune)
    exact = vectors.astype(np.int64) @ anchor
    assert (scores == exact[at]).all()
    assert set(np.argsort(-exact)[:5]) <= set(at)
    assert seen[0] < 200 and seen[-1] >= 5


def test_empty_table_and_table_without_anchors(spark, rows):
    assert found_by_op(spark.createDataFrame([], SCHEMA)) == []
    odd = [(*r, "x", 1) for r in rows if r[0] is not None and r[0] % 4]
    assert found_by_op(spark.createDataFrame(odd, SCHEMA)) == []


def test_registered_query_and_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf_dir), sf_dir, "op13_hard_negatives").startswith("MATCH")
