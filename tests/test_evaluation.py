import itertools

import pytest

from doccluster.operators import evaluation

SYSTEM = {1: "p", 2: "p", 3: "q", 4: "q", 5: "q", 6: "r"}
LABELS = {1: "x", 2: "y", 3: "y", 4: "y", 5: "x", 6: "z"}


@pytest.fixture(scope="module")
def tables(spark):
    def build(system, labels, tags=None):
        return (
            spark.createDataFrame(list(system.items()), "doc_id bigint, cluster_id string"),
            spark.createDataFrame(list(labels.items()), "doc_id bigint, label string"),
            spark.createDataFrame([(t,) for t in sorted(tags or set(labels.values()))], "label string"),
        )

    return build


def counted(system, labels):
    found = {"tp": 0, "fp": 0, "fn": 0, "tn": 0}
    for a, b in itertools.combinations(system, 2):
        together, alike = system[a] == system[b], labels[a] == labels[b]
        found[("tp" if alike else "fp") if together else ("fn" if alike else "tn")] += 1
    return found


def test_pair_counts_match_counting(tables):
    row = evaluation.pair_counts(*tables(SYSTEM, LABELS)).first()
    assert {c: int(row[c]) for c in ("tp", "fp", "fn", "tn")} == counted(SYSTEM, LABELS)


def test_single_metrics_agree_with_the_whole_row(tables):
    given = tables(SYSTEM, LABELS)
    row = evaluation.evaluate_clusters(*given).first()
    singles = {
        "purity": evaluation.purity,
        "rand_index": evaluation.rand_index,
        "precision": evaluation.pair_precision,
        "recall": evaluation.pair_recall,
        "f1": evaluation.pair_f1,
        "nmi": evaluation.nmi,
    }
    for name, metric in singles.items():
        assert metric(*given).first()[name] == pytest.approx(row[name])
    assert row.purity == pytest.approx(4 / 6)
    assert all(0 <= row[name] <= 1 for name in singles)


def test_perfect_clustering(tables):
    system = {1: "p", 2: "p", 3: "q", 4: "q"}
    row = evaluation.evaluate_clusters(*tables(system, system)).first()
    assert [row[m] for m in evaluation.METRICS] == pytest.approx([1.0] * 6)


def test_one_cluster_and_one_label_has_no_nmi(tables):
    system = {1: "p", 2: "p"}
    row = evaluation.evaluate_clusters(*tables(system, {1: "x", 2: "x"})).first()
    assert row.nmi is None and row.purity == 1.0


def test_labels_outside_the_tags_do_not_count(tables):
    cells = evaluation.contingency_table(*tables(SYSTEM, LABELS, tags={"x", "unused"})).collect()
    assert {(c.cluster_id, c.label, c.n) for c in cells} == {("p", "x", 1), ("q", "x", 1)}


def test_clusters_are_numbered_by_first_document(tables):
    system, _, _ = tables({5: "a", 2: "b", 9: "a", 7: "c"}, LABELS)
    rows = evaluation.relabel_clusters(system).collect()
    assert {r.doc_id: r.cluster_id for r in rows} == {2: 1, 5: 2, 9: 2, 7: 3}


def test_texts_are_cut_into_whole_chunks(tables, monkeypatch):
    monkeypatch.setattr(evaluation, "CHUNK_BITS", 1)
    system = tables(SYSTEM, LABELS)[0]
    numbered = evaluation.relabel_clusters(system)
    rows = {r.chunk: r.assignments for r in evaluation.assignment_string(numbered).collect()}
    assert rows == {0: "0 1|1 1", 1: "2 2|3 2", 2: "4 2|5 3"}
    sizes = {r.chunk: r.sizes for r in evaluation.size_list(numbered).collect()}
    assert sizes == {0: "2", 1: "3|1"}
