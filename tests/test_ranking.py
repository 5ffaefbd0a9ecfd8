import random
import statistics

import pytest

from doccluster.operators import ranking
from doccluster.operators.ranking import dense_position, exact_median


@pytest.mark.parametrize("spread", [1, 1000, 1 << 40])
def test_positions_follow_id_order(spark, monkeypatch, spread):
    monkeypatch.setattr(ranking, "CHUNK_ROWS", 7)
    ids = random.Random(spread).sample(range(-500, 500), 100)
    df = spark.createDataFrame([(n * spread,) for n in ids], "id bigint")
    rows = dense_position(df, "id", "position").collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.position)] == sorted(n * spread for n in ids)
    assert sorted(r.position for r in rows) == list(range(100))


def test_one_outlying_id_leaves_ranges_even(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CHUNK_ROWS", 100)
    ids = [*range(2000), 1 << 62]
    df = spark.createDataFrame([(n,) for n in ids], "id bigint")
    found = []
    keep = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda d, n: found.append(keep(d, n)) or found[-1])
    rows = dense_position(df, "id", "position").collect()
    assert sorted((r.id, r.position) for r in rows) == list(zip(ids, range(2001)))
    assert max(r["count"] for r in found[0].groupBy("_range").count().collect()) <= 300


def test_positions_of_nothing_and_of_one(spark):
    assert dense_position(spark.createDataFrame([], "id bigint"), "id", "p").count() == 0
    assert dense_position(spark.createDataFrame([(9,)], "id bigint"), "id", "p").first().p == 0


@pytest.mark.parametrize("kind", ["spread", "ties", "two", "constant", "single"])
@pytest.mark.parametrize("extra", [0, 1])
def test_median_is_exact(spark, monkeypatch, kind, extra):
    monkeypatch.setattr(ranking, "SMALL_ENOUGH", 5)
    rng = random.Random(3)
    size = 300 + extra
    values = {
        "spread": [rng.random() for _ in range(size)],
        "ties": [rng.choice([0.0, 0.0, 0.5, rng.random()]) for _ in range(size)],
        "two": [0.0] * (size // 2) + [1.0] * (size - size // 2),
        "constant": [0.25] * size,
        "single": [4.0] * (1 + extra),
    }[kind]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    assert exact_median(df, "s") == statistics.median(values)


def test_median_of_nothing(spark):
    assert exact_median(spark.createDataFrame([(None,)], "s double"), "s") is None
