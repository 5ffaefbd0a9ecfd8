"""Registered queries against their SQL on the smallest tables, and their plans."""

from pathlib import Path

import pytest

from check import compare, connect
from doccluster.operators import labeling, similarity, weighting
from doccluster.oracle import all_oracles
from doccluster.queries import all_queries, cat_docs

SF_DIR = "/root/testdata/sf0.001"
# Many rounds of small jobs; test_propagation covers them and check.py runs them.
ITERATIVE = ("ap_topn_sweep", "affinity")
COMPARED = [n for n in all_oracles() if not n.startswith(ITERATIVE)]

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", COMPARED)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name).startswith("MATCH")


@pytest.mark.parametrize("name", ["cluster_documents_ap_frey", "cluster_documents_ap_frey_auto"])
def test_frey_clusters_are_not_degenerate(con, name):
    rows = con.execute(all_oracles()[name]).fetchall()
    assert 1 < len({exemplar for _, exemplar, _ in rows}) < len(rows)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_plan_multiplies_tables(spark):
    docs = cat_docs(spark, SF_DIR)
    for df in (
        weighting.term_scores(docs),
        weighting.tf_icdf(docs),
        labeling.cluster_labels(docs),
        similarity.frey_similarity(docs.select("doc_id", "text"), 1.0, top_n=3),
    ):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_ranks_are_limited_before_the_shuffle(spark):
    docs = cat_docs(spark, SF_DIR)
    assert "WindowGroupLimit" in plan_of(labeling.cluster_labels(docs))


def test_scan_reads_the_needed_columns_only(spark):
    plan = plan_of(weighting.term_scores(cat_docs(spark, SF_DIR)))
    assert "n_chars" not in plan and "source" not in plan.replace("resource", "")


def test_preferences_write_no_table_of_all_pairs(spark, monkeypatch):
    from doccluster import queries
    from doccluster.sources import scratch

    written = []
    monkeypatch.setattr(queries, "materialize", lambda df, name: written.append(name) or scratch.materialize(df, name))
    assert all_queries()["embed_preferences"](spark, SF_DIR).count() > 0 and "edges" not in written


def test_edges_round_as_decimals_do(spark):
    import random

    from pyspark.sql import functions as F

    from doccluster.queries import edges, rounded

    rng = random.Random(6)
    values = [None, float("nan"), float("inf"), 0.0, -0.0, -1e-9, 5e-7, -0.0078125, 0.1234565, 1e12 + 1]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-7, 13) for _ in range(5000)]
    values += [(n + 0.5) / 1_000_000 for n in range(-300, 300)]
    df = spark.createDataFrame([(n, n, v) for n, v in enumerate(values)], "i bigint, k bigint, s double")
    both = edges(df).join(df.select("i", rounded("s", "want")), "i")
    assert both.filter(~F.col("s").eqNullSafe(F.col("want"))).count() == 0
