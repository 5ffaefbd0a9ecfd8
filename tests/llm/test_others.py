"""Toxicity, neighbours, shards, fixity, licenses, URL filters, the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from doccluster.llm import fixity, licenses, neighbours, sharding, toxicity, url_filters
from doccluster.sources import scratch
from doccluster.sources.scratch import materialize

SMALL = "/root/testdata/sf0.001"
MEAN = "idiot moron scum".split()


def sentences(count, seed=0):
    rng = random.Random(seed)
    plain = ["the", "and", "tionwh", "erth", "anre", "of", "ble", "ingsh", "haedea"]
    out = []
    for n in range(count):
        words = rng.choices(plain, k=30)
        if n % 4 == 0:
            for at in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(MEAN))
        out.append((n, " ".join(words), int(n % 4 == 0)))
    return out


# --- toxicity ---


def test_unseen_spelling_shares_ngrams():
    rows = sentences(400)
    model = toxicity.train([r[1] for r in rows], [r[2] for r in rows], 0.25)
    scores = model.scores(pa.array(["the of idiotts and the anre", "the of ble and the anre", "", None]))
    assert scores[0] > 0.3 > scores[1]
    assert scores[2] == scores[3] and ((scores >= 0) & (scores <= 1)).all()


def test_rare_toxic_words_are_learned_from_few_rows():
    rows = [(t, y) for _, t, y in sentences(80)]  # each word in fewer than 30 texts
    rows += [(t, 0) for _, t, y in sentences(400, 1) if not y]
    model = toxicity.train([t for t, _ in rows], [y for _, y in rows], 20 / len(rows))
    new = sentences(200, 2)
    caught = model.scores(pa.array([t for _, t, _ in new])) >= toxicity.THRESHOLD
    assert np.mean(caught == np.array([y == 1 for _, _, y in new])) > 0.95


def test_one_class_and_no_rows():
    for texts, toxic in (([], []), (["a b"], [1])):
        assert ((toxicity.train(texts, toxic, 0.0).scores(pa.array(["x", None])) <= 1)).all()


def test_ngram_buckets_do_not_cross_words():
    word, bucket = toxicity.ngram_buckets(pa.array(["ab", "ab", "é", "abc"]))
    of = [sorted(bucket[word == n]) for n in range(4)]
    assert of[0] == of[1] != of[3] and len(of[0]) == 2 + 1 + 1


def test_held_out_rows_are_scored_but_not_learned(spark):
    rows = sentences(300)
    docs = spark.createDataFrame(
        [(n, t, "clash") for n, t, _ in rows] + [(None, None, ""), (7, rows[7][1], "again"), (999, "x " * 40_000, "")],
        "doc_id bigint, text string, score string",
    )
    labels = spark.createDataFrame([(n, y) for n, _, y in rows] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model, other = toxicity.fit(docs, labels), toxicity.fit(docs, wrong)
    assert np.array_equal(model.weight, other.weight) and model.bias == other.bias
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == 303 and all(0 <= r.score <= 1 for r in scored)
    held = [(r.score >= 0.3) == (r.doc_id % 4 == 0) for r in scored if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean(held) > 0.95
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id = 4").count() == 0 and kept.filter("doc_id = 7").count() == 2
    assert toxicity.score(docs.limit(0), model).count() == 0


# --- neighbours ---


def test_rounds_and_steps_overwrite_their_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "checkpoint_root", lambda spark: str(tmp_path))
    rng = np.random.default_rng(5)
    rows = [(n, v) for n, v in enumerate(neighbours.pack(rng.normal(size=(400, 32))))]
    compact = spark.createDataFrame(rows, "node bigint, v binary")
    compact = materialize(compact, "packed")
    lists = neighbours.linked(neighbours.build_graph(compact, 32), compact)
    queries = compact.filter("node < 20").withColumnRenamed("node", "query")
    assert neighbours.search(queries, lists, 32, 128).count() == 20 * 128
    names = [p.name.split("-")[0] for p in (tmp_path / "doccluster").iterdir()]
    most = {"packed": 1, "graph": 2, "fresh": 1, "links": 2, "linked": 1, "beam": 2}
    assert {n: names.count(n) for n in names} == most


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(400, 6)).round(1)
    vectors[20:60] = vectors[20]  # forty copies
    rows = [(n, [float(x) for x in v], 0) for n, v in enumerate(vectors)]
    bad = [(500, None, 0), (600, [0.0] * 6, 0), (700, [1.0, None] * 3, 0), (800, [float("nan")] * 6, 0), (900, [float("inf")] * 6, 0), (1000, [1.0], 0), (None, [1.0] * 6, 0), rows[20]]
    table = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, node int")
    found = neighbours.nearest_neighbours(table, F.col("vec_id") % 10 == 0).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 10))
    hits = 0
    for q, answers in got.items():
        exact = sorted((float(np.sqrt(((vectors[q] - v) ** 2).sum())), n) for n, v in enumerate(vectors) if n != q)
        answers.sort()
        assert [a[0] for a in answers] == list(range(1, 11))
        hits += len({n for _, n in exact[:10]} & {n for _, n, _ in answers})
        for _, n, score in answers:
            assert abs(score - np.sqrt(((vectors[q] - vectors[n]) ** 2).sum())) < 1e-12
        assert [(s, n) for _, n, s in answers] == sorted((s, n) for _, n, s in answers)
    assert hits / (10 * len(got)) >= 0.97
    assert [n for _, n, _ in got[20]] == list(range(21, 31))  # ties by the smaller id
    assert neighbours.nearest_neighbours(table.limit(0), F.lit(True)).count() == 0
    two = spark.createDataFrame(rows[:2], table.schema)
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest_neighbours(two, F.lit(True)).orderBy("query_id").collect()] == [(0, 1), (1, 0)]


def test_short_form_keeps_three_digits():
    values = np.array([[1e30, -1e29, 0], [1e-10, 3e-10, 2e-10], [0.5, 0.25, 1]])
    back = neighbours.unpacked(pa.array(neighbours.pack(values), pa.binary()), 3)
    assert np.allclose(back[1:], values[1:], rtol=1e-3) and np.isfinite(back).all()


def recall(spark, vectors, every):
    rows = [(n, [float(x) for x in v]) for n, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.nearest_neighbours(table, F.col("vec_id") % every == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(range(0, len(vectors), every)) and {len(g) for g in got.values()} == {10}
    hits = 0
    for q, found in got.items():
        gap = ((vectors - vectors[q]) ** 2).sum(axis=1)
        gap[q] = np.inf
        hits += len(found & set(np.argsort(gap, kind="stable")[:10].tolist()))
    return hits / (10 * len(got))


@pytest.mark.parametrize("noise, common", [(1e-6, 0.0), (1e-10, 0.0), (1e-3, 1e4)])
def test_neighbours_among_copies_with_float_noise(spark, noise, common):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1800, 8))
    vectors[:1500] = vectors[0] + noise * rng.normal(size=(1500, 8))
    vectors[:, 0] += common
    assert recall(spark, vectors, 30) >= 0.95


def test_search_ends_when_no_node_is_open(spark):
    # a path: every step reaches one node more
    packed = neighbours.pack(np.arange(40.0)[:, None] + 1)
    near = lambda n: [m for m in (n - 1, n + 1) if 0 <= m < 40]
    rows = [(n, near(n), [packed[m] for m in near(n)]) for n in range(40)]
    lists = materialize(spark.createDataFrame(rows, "node bigint, ids array<bigint>, vs array<binary>"), "lists")
    queries = spark.createDataFrame([(0, packed[0])], "query bigint, v binary")
    assert {r.node for r in neighbours.search(queries, lists, 1, 16).collect()} == set(range(16))
    vectors = spark.createDataFrame(list(enumerate(packed)), "node bigint, v binary")
    assert [tuple(r) for r in neighbours.exact_limits(queries.collect(), vectors, 1).collect()] == [(0, 10, 100.0)]


def test_graph_holds_most_of_the_nearest_before_any_search(spark):
    vectors = np.random.default_rng(3).normal(size=(4000, 64))
    rows = [(n, v) for n, v in enumerate(neighbours.pack(vectors))]
    compact = materialize(spark.createDataFrame(rows, "node bigint, v binary"), "compact")
    hits = 0
    graph = neighbours.build_graph(compact, 64).filter("node % 40 = 0").collect()
    for row in graph:
        gap = ((vectors - vectors[row.node]) ** 2).sum(axis=1)
        gap[row.node] = np.inf
        hits += len(set(np.argsort(gap)[:10].tolist()) & {e.other for e in row.near})
    assert len(graph) == 100 and hits / 1000 >= 0.93


@pytest.mark.parametrize("common", [0.0, 1e6])
def test_products_rule_out_no_pair_within_a_limit(common):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(30, 12, 5)) + common
    vectors[:, 6:] = vectors[:, :6] + 1e-9 * rng.normal(size=(30, 6, 5))
    ids = rng.permutation(360).reshape(30, 12)
    fresh = rng.random((30, 12)) < 0.5
    # limits are gaps that occur, so that equal ones are met
    limit = ((vectors - np.roll(vectors, 6, axis=1)) ** 2).sum(axis=2) * rng.choice([1, 4, 1e18], (30, 12))
    want = set()
    for r in range(30):
        for x in range(12):
            for y in range(12):
                gap = neighbours.gaps(vectors[r, [x]], vectors[r, [y]])[0]
                if x != y and (fresh[r, x] or fresh[r, y]) and gap < limit[r, x]:
                    want.add((ids[r, x], ids[r, y], gap))
    assert want and set(zip(*neighbours._pairs_of(ids, vectors, limit, fresh))) == want


# --- shards ---


def test_shards_are_even_and_keep_equal_texts_together(spark):
    texts = [f"text {n}" for n in range(300)] + ["copy"] * 200 + ["pair", "pair"] * 3 + [None] * 5 + [""] * 2
    docs = spark.createDataFrame([(n if n % 7 else None, t, 1) for n, t in enumerate(texts)], "doc_id bigint, text string, shard int")
    rows = sharding.shard_documents(docs, shards=8).collect()
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    counts = [len(s) for s in slots.values()]
    assert len(slots) == 8 and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    crc = zlib.crc32(b"pair")
    assert len({r.shard for r in rows if r.text_crc32 == crc and r.size == 20}) == 1
    # two hundred copies need four of the shards of about 64 rows
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"copy")}) <= 5
    assert {r.size for r in rows if r.text_crc32 == 0} == {16}


def links_of(spark, texts, shards):
    base = spark.createDataFrame(list(enumerate(texts)), "uid bigint, text string")
    base = materialize(base.select("uid", F.unhex(F.sha2("text", 256)).alias("digest")), "base")
    quotas = [len(texts) // shards + (n < len(texts) % shards) for n in range(shards)]
    return sharding.text_links(base, quotas[-1]), quotas


def test_propagation_gathers_links(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    links, quotas = links_of(spark, [r.text for r in docs.select("text").collect()], 40)
    state, cuts = sharding.propagate(links, quotas)
    assert cuts[0] > 0 and cuts[-1] == 0
    # the cut by hand: members outside the shard of most of their hub
    hubs = {}
    for r in state.collect():
        hubs.setdefault(r.hub, []).append(r.shard)
    assert all(len(set(h)) == 1 for h in hubs.values())


def test_full_shards_exchange(spark):
    # every document has a partner, so no shard has room to spare
    links, quotas = links_of(spark, [f"text {n // 2}" for n in range(800)], 8)
    state, cuts = sharding.propagate(links, quotas)
    assert cuts[0] > 300 and cuts[-1] <= cuts[0] // 10
    assert cuts == sorted(cuts, reverse=True)
    assert state.select("uid").distinct().count() == 800


def test_allowance_keeps_quotas():
    flows = {(0, 1): 7, (1, 0): 4, (2, 1): 5, (0, 2): 3}
    allowed = sharding._allowance(flows, [0, 2, 0])
    assert allowed == {(0, 1): 6, (1, 0): 4, (2, 1): 0, (0, 2): 0}


def test_shards_of_few_or_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id bigint, text string")
    assert sorted(r.slot for r in sharding.shard_documents(docs, shards=8).collect()) == [0, 0, 0]
    assert sharding.shard_documents(docs.limit(0), shards=8).count() == 0


# --- fixity ---


def test_audit_finds_what_differs(spark):
    rows = [(n, f"record {n}") for n in range(5000)] + [(7, "second"), (7, "second"), (None, "no key"), (None, "no key")]
    changed = [(k, r + "!" if k == 4100 else r) for k, r in rows if k != 9]
    changed.remove((7, "second"))
    changed.append((6000, "new"))
    first, second = (materialize(fixity.tree(spark.createDataFrame(x, "page_id bigint, record string")), "t") for x in (rows, changed))
    found = fixity.audit(first, second).collect()
    leaves = {(r.file, r.node): (r.first_hash is None, r.second_hash is None) for r in found if r.level == 0}
    assert leaves == {(0, 7): (False, False), (0, 9): (False, True), (1, 4): (False, False), (1, 1904): (True, False)}
    assert {(r.file, r.level) for r in found if r.level == 3} == {(0, 3), (1, 3)}
    assert fixity.audit(first, first).count() == 0
    empty = fixity.tree(spark.createDataFrame([], "page_id bigint, record string"))
    assert fixity.audit(empty, empty).count() == 0
    roots = [r.hash for r in first.filter("level = 3").collect()]
    assert all(len(h) == len(hashlib.sha256().hexdigest()) for h in roots)


def test_record_of_null_parts(spark):
    row = spark.createDataFrame([(None, None)], "url string, html string")
    text = row.select(fixity.warc_record(F.col("url"), F.col("html"))).first()[0]
    assert "Content-Length: 0" in text


# --- licenses ---


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def test_licenses_equal_exact_containment(spark):
    rng = random.Random(4)
    filler = [f"w{n}" for n in range(50)]
    rows = [(None, None, "c"), (0, "", "c"), (1, "too short", "c")]
    for n in range(2, 60):
        listed = rng.choices(filler, k=rng.randint(0, 60))
        for text in rng.sample(sorted(licenses.TEMPLATES.values()), rng.randint(0, 2)):
            own = words(text)
            if n % 3 == 0:
                own = own[: max(5, len(own) * 2 // 3)]
            at = rng.randint(0, len(listed))
            listed[at:at] = own
        rows.append((n, " ".join(listed), "c"))
    rows.append((99, "Released under the MIT License. " + "x y " * 20_000 + " ".join(licenses.TEMPLATES.values()), "c"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, licenses string")

    def shingles(listed):
        return {" ".join(listed[i : i + 5]) for i in range(len(listed) - 4)}

    for r in licenses.scan(docs).collect():
        listed = words(next(t for n, t, _ in rows if n == r.doc_id))
        expected = {}
        for name, text in licenses.TEMPLATES.items():
            own, scale = shingles(words(text)), licenses.scale_for(len(words(text)) - 4)
            for start in range(0, max(0, len(listed) - 4), scale.step):
                share = len(own & shingles(listed[start : start + scale.size + 4])) / len(own)
                if share >= 0.8:
                    expected[name] = max(share, expected.get(name, 0))
        assert {x.license: x.containment for x in r.licenses} == expected
    assert licenses.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, {"short": "only four words here"})


def test_windows_hold_templates():
    for shingles in range(1, 200):
        scale = licenses.scale_for(shingles)
        assert scale.size == 1 or shingles <= scale.size - scale.step
        assert shingles * 8 >= scale.size * 2


# --- URL filters ---


def test_entry_active_at_fetch_time_decides(spark):
    entries = spark.createDataFrame(
        [("example.com", 10, "block"), ("example.com", 50, "allow"), ("a.example.com", 20, "allow"), ("example.com", 10, "allow"), (None, 1, "block"), ("x.org", None, "block"), ("b.org", 400, "block")],
        "domain string, day bigint, action string",
    )
    urls = [
        (1, "http://A.example.com/x", 15), (2, "https://a.example.com:80", 25), (3, "http://example.com?q", 9), (4, "http://u:p@b.example.com#f", 49),
        (5, "http://example.com", 50), (6, None, 5), (7, "no url", 5), (8, "http://b.org", None), (9, "http://b.org", 500), (9, "http://b.org", 500), (None, "http://notexample.com", 20),
    ]
    captures = spark.createDataFrame(urls, "id bigint, url string, day bigint").withColumn("host", url_filters.host_of(F.col("url")))
    rows = url_filters.filter_urls(captures, entries).collect()
    got = sorted(repr((r.id, r.domain, r.valid_from, r.action)) for r in rows)
    expected = [
        (1, "example.com", 10, "block"), (2, "a.example.com", 20, "allow"), (3, None, None, None), (4, "example.com", 10, "block"), (5, "example.com", 50, "allow"),
        (6, None, None, None), (7, None, None, None), (8, None, None, None), (9, "b.org", 400, "block"), (9, "b.org", 400, "block"), (None, None, None, None),
    ]
    assert got == sorted(map(repr, expected))
    assert url_filters.filter_urls(captures, entries.limit(0)).filter("action IS NOT NULL").count() == 0
    assert url_filters.filter_urls(captures.limit(0), entries).count() == 0


@pytest.mark.parametrize("module", [url_filters, licenses])
def test_native_operators_run_no_python(spark, module):
    docs = spark.createDataFrame([(1, "http://a.b.c Released under the MIT License.")], "doc_id bigint, text string")
    if module is licenses:
        df = licenses.scan(docs)
    else:
        captures = docs.select(F.lit("a.b.c").alias("host"), F.lit(3).alias("day"))
        df = url_filters.filter_urls(captures, url_filters.dated_entries(captures.select("host")))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- the pipeline ---


def test_pipeline_keeps_columns_and_packs_what_is_left(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(packed) == corpus_pipeline.run(spark, SMALL).count()
