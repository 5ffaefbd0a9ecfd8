"""k-means against plain loops over dense vectors."""

import hashlib
import math
import random
from collections import Counter

import pytest

from doccluster.operators import kmeans
from doccluster.sources.scratch import materialize

BUCKETS = 64


def bucket(term):
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % BUCKETS


def some_texts():
    rng = random.Random(9)
    topics = ["ant bee cat dog".split(), "oak elm fir yew ash".split(), "tin lead iron gold".split()]
    texts = {n: " ".join(rng.choices(topics[n % 3], k=rng.randint(2, 9))) for n in range(40)}
    texts |= {100: "...", 101: "...", 102: texts[1], 103: texts[1], 104: "sun"}
    return texts


def plain_vectors(texts):
    bags = {d: Counter(map(bucket, t.split())) if t != "..." else Counter() for d, t in texts.items()}
    df = Counter(b for bag in bags.values() for b in bag)
    idf = {b: math.log((len(texts) + 1) / (n + 1)) for b, n in df.items()}
    return {d: [bag[b] * idf.get(b, 0.0) for b in range(BUCKETS)] for d, bag in bags.items()}


def plain_kmeans(vectors, k, rounds, seed, run=0):
    def start(d):
        return hashlib.md5(f"{seed}:{run}:{d}".encode()).hexdigest(), d

    def nearest(v):
        return min(
            (round(sum((x - y) ** 2 for x, y in zip(v, c)), 6), j) for j, c in enumerate(centers)
        )

    centers = [vectors[d] for d in sorted(vectors, key=start)[:k]]
    for _ in range(rounds):
        held = {d: nearest(v)[1] for d, v in vectors.items()}
        for j in range(len(centers)):
            mine = [vectors[d] for d, c in held.items() if c == j]
            if mine:
                centers[j] = [sum(x) / len(mine) for x in zip(*mine)]
    found = {d: nearest(v) for d, v in vectors.items()}
    return {d: j for d, (_, j) in found.items()}, sum(cost for cost, _ in found.values())


@pytest.fixture(scope="module")
def features(spark):
    docs = spark.createDataFrame(list(some_texts().items()), "doc_id bigint, text string")
    return materialize(kmeans.tfidf_vectors(docs.repartition(3), BUCKETS), "test-features")


def test_vectors_merge_the_terms_of_a_bucket(features):
    got = {}
    for row in features.collect():
        got.setdefault(row.doc_id, {})[row.bucket] = row.weight
    for doc_id, vector in plain_vectors(some_texts()).items():
        bag = some_texts()[doc_id]
        if bag == "...":
            assert got[doc_id] == {None: None}
        else:
            assert got[doc_id] == pytest.approx({b: vector[b] for b in map(bucket, bag.split())})


@pytest.mark.parametrize("k,rounds,limit", [(3, 1, 1 << 23), (3, 10, 0), (7, 4, 1 << 23), (1, 3, 0)])
def test_rounds_like_plain_loops(features, monkeypatch, k, rounds, limit):
    monkeypatch.setattr(kmeans, "BROADCAST_WEIGHTS", limit)
    model = kmeans.kmeans(features, k, rounds, seed=5, num_features=BUCKETS)
    got = {r.doc_id: r.cluster_id for r in kmeans.kmeans_assignments(model, features).collect()}
    want, cost = plain_kmeans(plain_vectors(some_texts()), k, rounds, 5)
    assert got == want
    assert kmeans.total_cost(features, model) == pytest.approx(cost, abs=1e-4)


def test_the_cheapest_run_is_returned(features):
    vectors = plain_vectors(some_texts())
    costs = [plain_kmeans(vectors, 4, 5, 5, run)[1] for run in range(3)]
    model = kmeans.kmeans(features, 4, 5, runs=3, seed=5, num_features=BUCKETS)
    assert kmeans.total_cost(features, model) == pytest.approx(min(costs), abs=1e-4)


def test_an_empty_cluster_keeps_its_center(spark):
    rows = [(1, 0, 1.0), (2, 0, 1.0), (3, 1, 5.0)]
    features = materialize(spark.createDataFrame(rows, "doc_id long, bucket int, weight double"), "f")
    first = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "doc_id long, cluster_id long")
    model = kmeans._new_centers(features, first, [1, 1, 1], BUCKETS)
    assigned = kmeans._assigned(features, model)
    assert {r.doc_id: r.cluster_id for r in assigned.collect()} == {1: 0, 2: 0, 3: 2}
    again = kmeans._new_centers(features, assigned, [2, 0, 1], BUCKETS, model)
    assert again.norms == [1.0, 1.0, 25.0]


def test_fewer_documents_than_clusters_and_none(spark, features):
    few = materialize(features.filter("doc_id < 2"), "few")
    model = kmeans.kmeans(few, 5, 3, num_features=BUCKETS)
    assert len(model.norms) == 2
    none = materialize(features.limit(0), "none")
    model = kmeans.kmeans(none, 3, 3, num_features=BUCKETS)
    assert kmeans.kmeans_assignments(model, none).collect() == []


def test_rounds_do_not_join_documents_with_their_clusters(features, monkeypatch):
    """A round shuffles sums per bucket only; documents are packed once."""
    whole = kmeans.kmeans(features, 3, 4, seed=5, num_features=BUCKETS)

    def joined(*_):
        raise AssertionError("the features are joined by document again")

    monkeypatch.setattr(kmeans, "_assigned", joined)
    again = kmeans.kmeans(features, 3, 4, seed=5, num_features=BUCKETS)
    assert again.norms == pytest.approx(whole.norms)
