import random

import pytest
from pyspark.sql import functions as F

from doccluster.operators import propagation
from doccluster.operators.similarity import symmetrize_edges, top_n_neighbors
from doccluster.plans import clustering
from doccluster.plans.clustering import (
    ap_topn_sweep,
    cluster_documents_ap,
    with_isolated_documents,
)

TOPICS = ["red green blue", "salt pepper oil", "oak elm ash"]


def reference_rounds(similarity, nodes, rounds, damping=0.5):
    """Dense message passing by the published update rules."""
    low = float("-inf")
    s = {(i, k): similarity.get((i, k), low) for i in nodes for k in nodes}
    r = {e: 0.0 for e in similarity}
    a = dict(r)
    for _ in range(rounds):
        new_r = {}
        for i, k in similarity:
            rivals = [a[i, j] + s[i, j] for j in nodes if j != k and (i, j) in similarity]
            new_r[i, k] = damping * r[i, k] + (1 - damping) * (s[i, k] - max(rivals, default=low))
        r = new_r
        new_a = {}
        for i, k in similarity:
            support = sum(
                max(0.0, r[j, k]) for j in nodes if j not in (i, k) and (j, k) in similarity
            )
            target = support if i == k else min(0.0, r[k, k] + support)
            new_a[i, k] = damping * a[i, k] + (1 - damping) * target
        a = new_a
    choice = {}
    for i in nodes:
        options = [(-round(a[i, k] + r[i, k], 9), k) for k in nodes if (i, k) in similarity]
        choice[i] = min(options)[1]
    exemplars = {i for i in nodes if choice[i] == i}
    result = {}
    for i in nodes:
        near = [(-s[i, k], k) for k in exemplars if k != i and (i, k) in similarity]
        result[i] = i if i in exemplars else (min(near)[1] if near else i)
    return result


def graph(spark, rows):
    return spark.createDataFrame(rows, "i bigint, k bigint, s double")


@pytest.mark.parametrize("symmetric", [True, False])
def test_matches_dense_message_passing(spark, symmetric):
    rng = random.Random(11)
    nodes = list(range(1, 13))
    pairs = [(i, k) for i in nodes for k in nodes if i < k and rng.random() < 0.6]
    half = {p: rng.random() for p in pairs}
    whole = {**half, **{(k, i): (s if symmetric else s * rng.random()) for (i, k), s in half.items()}}
    given = half if symmetric else whole
    edges = propagation.embed_preferences(graph(spark, [(*p, s) for p, s in given.items()]), 0.3)
    got = propagation.affinity_propagation(edges, 9, symmetric=symmetric).collect()
    used = sorted({n for p in whole for n in p})
    want = reference_rounds({**whole, **{(n, n): 0.3 for n in used}}, used, 9)
    assert {r.doc_id: r.exemplar for r in got} == want
    ranks = {e: n for n, e in enumerate(sorted(set(want.values())))}
    assert all(r.cluster_id == ranks[r.exemplar] for r in got)


def test_two_groups_with_a_bridge(spark):
    rows = [
        (1, 2, 0.95), (1, 3, 0.9), (2, 3, 0.8), (4, 5, 0.9), (4, 6, 0.8), (5, 6, 0.95), (3, 4, 0.1)
    ]
    edges = propagation.embed_preferences(graph(spark, rows), 0.4)
    clusters = propagation.affinity_propagation(edges, 20)
    groups = {}
    for r in clusters.collect():
        groups.setdefault(r.cluster_id, set()).add(r.doc_id)
        assert r.exemplar in ({1, 2, 3} if r.doc_id < 4 else {4, 5, 6})
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5, 6]]
    members = propagation.cluster_members(clusters, chunk_bits=1)
    assert all(len(r.members) <= 2 for r in members.collect())
    back = {(r.doc_id, r.cluster_id) for r in propagation.ap_assignments(members).collect()}
    assert back == {(r.doc_id, r.cluster_id) for r in clusters.collect()}


def test_repeated_edges_keep_the_largest(spark):
    edges = graph(spark, [(1, 2, 0.1), (2, 1, 0.7), (1, 1, 0.0), (2, 2, 0.0)])
    rows = propagation._graph(edges, symmetric=True).collect()
    assert {(r.i, r.k): r.s for r in rows} == {(1, 2): 0.7, (2, 1): 0.7, (1, 1): 0.0, (2, 2): 0.0}


def test_node_with_only_its_own_edge_stands_alone(spark):
    edges = graph(spark, [(1, 2, 0.5), (1, 1, -1.0), (2, 2, 0.2), (9, 9, -3.0)])
    rows = propagation.affinity_propagation(edges, 5, symmetric=True).collect()
    assert {r.doc_id: r.exemplar for r in rows}[9] == 9


def test_preferences(spark):
    edges = graph(spark, [(1, 2, 0.2), (2, 3, 0.4), (1, 3, 0.9), (1, 1, 7.0)])
    own = {r.i: r.s for r in propagation.auto_preferences(edges).filter("i = k").collect()}
    assert own == {1: 0.4, 2: 0.4, 3: 0.4}
    own = {r.i: r.s for r in propagation.embed_preferences(edges, -2).filter("i = k").collect()}
    assert own == {1: -2.0, 2: -2.0, 3: -2.0}


@pytest.fixture(scope="module")
def topic_docs(docs_of):
    # the first document of a topic holds its words only, the others one more
    extra = ["", "apart", "besides", "curious"]
    texts = {
        10 * t + n: f"{TOPICS[t]} {TOPICS[t]} {extra[n] and extra[n] + 'xyz'[t]}"
        for t in range(3)
        for n in range(4)
    }
    texts[99] = "..."
    return docs_of(texts)


@pytest.mark.parametrize("similarity, preference", [("C", 0.5), ("C", "auto"), ("F", 1.0), ("F", "auto")])
def test_clusters_follow_topics(topic_docs, similarity, preference):
    rounds = 15 if preference == 0.5 else 3
    pruned = {"pruned": True, "top_n": 4} if similarity == "F" else {}
    rows = cluster_documents_ap(topic_docs, similarity, preference, rounds, **pruned).collect()
    assert len(rows) == 12
    if (similarity, preference) == ("C", 0.5):
        assert {(r.doc_id // 10, r.exemplar // 10) for r in rows} == {(t, t) for t in range(3)}
        assert {r.cluster_id for r in rows} == {0, 1, 2}


def test_a_node_without_preference_is_an_error(spark):
    with pytest.raises(ValueError, match="self edge"):
        propagation.affinity_propagation(graph(spark, [(1, 1, 0.5), (1, 2, 0.3)]), 2)


def test_bad_arguments(topic_docs):
    with pytest.raises(ValueError, match="top_n"):
        cluster_documents_ap(topic_docs, "F", "auto", 5)
    with pytest.raises(ValueError):
        cluster_documents_ap(topic_docs, "X", "auto", 5)
    with pytest.raises(ValueError):
        cluster_documents_ap(topic_docs, "C", "auto", 5, pruned=True)


def test_isolated_documents_get_their_own_cluster(spark, topic_docs):
    clusters = graph(spark, []).select(
        F.col("i").alias("doc_id"), F.col("k").alias("exemplar"), F.col("i").alias("cluster_id")
    )
    rows = with_isolated_documents(topic_docs, clusters).collect()
    assert len(rows) == 13 and all(r.doc_id == r.exemplar for r in rows)
    assert sorted(r.cluster_id for r in rows) == list(range(13))


def test_sweep_reports(topic_docs):
    gold = topic_docs.select("doc_id", F.floor(F.col("doc_id") / 10).cast("string").alias("label"))
    tags = gold.select("label").distinct()
    system, result = ap_topn_sweep(topic_docs, gold, tags, 0.5, start=1, end=1, max_iter=8)
    line = system.first()
    assert (line.category, line.setting, line.n_clusters) == ("all", "10", 4)
    assert line.sizes == "4|4|4|1"
    assert line.assignments.startswith("0 0|1 0|") and line.assignments.endswith("|12 3")
    assert result.first().purity == 1.0


def test_settings_in_one_loop_equal_separate_graphs(spark):
    edges = [(i, k, ((i * 7 + k * 13) % 29) / 29) for i in range(14) for k in range(i + 1, 14)]
    df = spark.createDataFrame(edges, "i bigint, k bigint, s double")
    settings = range(0, 3)
    together = propagation.exemplars_of(clustering._setting_graphs(df, settings, "auto"), 6).collect()
    for n in settings:
        graph = df
        if n:
            graph = top_n_neighbors(symmetrize_edges(df), clustering.SWEEP_TOP_N[n])
        alone = propagation.affinity_propagation(propagation.auto_preferences(graph), 6)
        assert {r.doc_id.id: r.exemplar.id for r in together if r.doc_id.setting == n} == {
            r.doc_id: r.exemplar for r in alone.collect()
        }


def test_auto_preferences_does_not_write_its_edges(spark, tmp_path, monkeypatch):
    from doccluster import queries
    from doccluster.operators import ranking
    from doccluster.sources import scratch

    monkeypatch.setattr(scratch, "checkpoint_root", lambda spark: str(tmp_path))
    monkeypatch.setattr(ranking, "SMALL_ENOUGH", 100)
    found = queries.all_queries()["auto_preferences"](spark, "/root/testdata/sf0.001")
    rows = [(r.i, r.k, float(r.s)) for r in found.collect()]
    others = [s for i, k, s in rows if i != k]
    middle = sorted(others)[(len(others) - 1) // 2 : len(others) // 2 + 1]
    assert len(others) > 5000
    own = [s for i, k, s in rows if i == k]
    assert own == pytest.approx([sum(middle) / len(middle)] * len(own), abs=2e-6)
    names = {p.name.split("-")[0] for p in (tmp_path / "doccluster").iterdir()}
    assert "bracket" in names and "edges" not in names
