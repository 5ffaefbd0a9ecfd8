import math
from collections import Counter

import pytest

from doccluster.operators import labeling, stats, weighting
from doccluster.sources.scratch import materialize

ROWS = [
    ("a", 1, "shared apple apple"),
    ("a", 2, "shared apple pear"),
    ("b", 3, "shared plum"),
    ("b", 4, "shared plum pear"),
    ("b", 5, "x 1"),
]


@pytest.fixture(scope="module")
def corpus(cat_docs_of):
    return cat_docs_of(ROWS)


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def glog(x):
    return math.log(x) if x > 0 else 0.0


def expected_scores(term):
    """The two sums written out over sets of documents."""
    n = len(ROWS)
    by_cate = {c: [set(t.split()) for k, _, t in ROWS if k == c] for c in "ab"}
    p_t = sum(term in d for docs in by_cate.values() for d in docs) / n
    lig = ig = 0.0
    for docs in by_cate.values():
        hits = sum(term in d for d in docs)
        if not hits:
            continue
        p_c, p_ct = len(docs) / n, hits / n
        for p, q in ((p_ct, p_c * p_t), (p_c - p_ct, p_c * (1 - p_t))):
            lig += abs(p * (1 - glog(p)) - q * (1 - glog(q)))
            ig += p * glog(p / q) if q else 0.0
    return lig, ig


def test_scores_match_the_formulas(corpus):
    rows = as_dict(weighting.term_scores(corpus), "term")
    assert set(rows) == {("shared",), ("apple",), ("pear",), ("plum",)}
    for (term,), row in rows.items():
        assert (row.lig, row.ig) == pytest.approx(expected_scores(term))


def test_term_in_every_document_scores_zero(cat_docs_of):
    df = cat_docs_of([("a", 1, "word"), ("a", 2, "word"), ("b", 3, "word")])
    row = weighting.term_scores(df).first()
    assert (row.lig, row.ig) == (pytest.approx(0), pytest.approx(0))


def test_category_size_counts_documents_without_terms(corpus):
    assert {r.cate: r.n_docs for r in stats.category_size(corpus).collect()} == {"a": 2, "b": 3}


def test_tf_icdf(corpus):
    rows = as_dict(weighting.tf_icdf(corpus), "doc_id", "term")
    assert rows[(1, "apple")].weight == pytest.approx(0)
    assert rows[(2, "pear")].weight == pytest.approx(math.log(2) * math.log(2))
    assert rows[(4, "pear")].weight == pytest.approx(math.log(2) * math.log(3))


def test_top_n_ranks_over_all_categories(corpus):
    kept = as_dict(weighting.tf_icdf(corpus, top_n=3), "cate", "term")
    assert set(kept) == {("a", "apple"), ("a", "shared"), ("b", "plum")}


def test_large_selection_is_not_broadcast(corpus, monkeypatch):
    monkeypatch.setattr(weighting, "BROADCAST_ROWS", 1)
    kept = as_dict(weighting.tf_icdf(corpus, top_n=3), "cate", "term")
    assert set(kept) == {("a", "apple"), ("a", "shared"), ("b", "plum")}


def test_tf_products(corpus):
    scores = as_dict(weighting.term_scores(corpus), "term")
    for build, factor, score in (
        (weighting.tf_lig, 2, "lig"),
        (weighting.log_tf_lig, math.log(3), "lig"),
        (weighting.log_tf_ig, math.log(3), "ig"),
    ):
        row = as_dict(build(corpus), "doc_id", "term")[(1, "apple")]
        assert row.weight == pytest.approx(factor * scores[("apple",)][score])


def test_vectors_hold_every_term_once(corpus):
    vectors = weighting.doc_weight_vectors(weighting.tf_lig(corpus)).collect()
    terms = {r.doc_id: [t.term for t in r.terms] for r in vectors}
    assert terms == {1: ["apple", "shared"], 2: ["apple", "pear", "shared"],
                     3: ["plum", "shared"], 4: ["pear", "plum", "shared"]}


def best_labels(cate, terms, k):
    df = Counter(t for c, _, text in ROWS if c == cate for t in set(text.split()))
    ranked = sorted((-df[t] * expected_scores(t)[0], t) for t in terms if df[t])
    return [t for _, t in ranked[:k]]


def test_labels_are_ranked_and_limited(corpus):
    terms = ["shared", "apple", "pear", "plum"]
    rows = labeling.cluster_labels(corpus, k=2).collect()
    got = {c: [r.term for r in sorted(rows, key=lambda r: r.rank) if r.cate == c] for c in "ab"}
    assert got == {c: best_labels(c, terms, 2) for c in "ab"}
    top_terms = sorted(terms, key=lambda t: (-expected_scores(t)[0], t))[:2]
    nested = labeling.nest_labels(labeling.cluster_labels(corpus, num_features=2)).collect()
    assert {r.cate: [t.term for t in r.labels] for r in nested} == {
        c: labels for c in "ab" if (labels := best_labels(c, top_terms, 10))
    }


def test_posting_chunks_are_bounded_and_whole(corpus):
    lists = stats.posting_lists(stats.term_frequency(corpus), chunk_bits=1).collect()
    shared = sorted((r.chunk, [(p.doc_id, p.tf) for p in r.postings]) for r in lists if r.term == "shared")
    assert shared == [(0, [(1, 1)]), (1, [(2, 1), (3, 1)]), (2, [(4, 1)])]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weightings_share_one_join_of_scores(cat_docs_of):
    docs = cat_docs_of([("x", 1, "ant bee bee"), ("y", 2, "bee cat"), ("y", 3, "cat cat ant")])
    scored = weighting.scored_tf(stats.term_frequency(docs), weighting.term_scores(docs))
    scored = materialize(scored, "scored")
    for weigh in (weighting.log_tf_lig, weighting.log_tf_ig):
        assert "Join" not in plan_of(weigh(docs, scored))
        got = {tuple(row) for row in weigh(docs, scored).collect()}
        assert got == {tuple(row) for row in weigh(docs).collect()}


def test_postings_are_not_sorted_to_meet_their_scores(spark, cat_docs_of):
    docs = cat_docs_of([("x", 1, "ant bee bee"), ("y", 2, "bee cat")])
    tf = materialize(stats.term_frequency(docs), "tf")
    scores = materialize(weighting.term_scores(docs, tf), "scores")
    plan = plan_of(weighting.tf_lig(docs, tf, scores))
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
