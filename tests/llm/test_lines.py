import hashlib
import random

import pytest

from check import compare, connect
from doccluster.llm import lines

BLANKS = " \t\n\x0b\f\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute_force(rows, least_length=20, least_docs=3):
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key_of(line)) >= least_length:
                holders.setdefault(key_of(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        found = (text or "").split("\n")
        kept = [
            line
            for line in found
            if doc_id is None
            or len(holders.get(key_of(line), ())) < least_docs
            or max(holders[key_of(line)]) == doc_id
            or len(key_of(line)) < least_length
        ]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((str(doc_id), len(found), len(found) - len(kept), digest))
    return sorted(out)


def found_by_op(docs, **limits):
    kept = lines.kept_text(lines.F.col("text"), lines.F.col("keep"))
    digest = {"kept_sha256": lines.F.sha2(kept, 256)}
    rows = lines.keep_bitmaps(docs, digest=digest, **limits).collect()
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    common = [f"a line that many documents share, number {n}" for n in range(12)]
    common += ["À la Recherche du Temps PERDU, tome ç", "x" * 20, "y" * 19]
    out = []
    for doc_id in range(300):
        picked = rng.choices(common, k=rng.randint(0, 9)) + [f"only document {doc_id} holds this line"]
        picked = [rng.choice(["", " ", "\t", "\r"]) + rng.choice([p, p.upper()]) + rng.choice(["", "\x0b "]) for p in picked]
        rng.shuffle(picked)
        out.append((doc_id, "\n".join(picked)))
    out += [(None, common[0]), (None, common[0]), (400, None), (401, ""), (402, "\n\n")]
    out += [(5, out[5][1]), (6, common[1]), (403, "\n".join(common * 60))]
    return out


@pytest.mark.parametrize("hot_rows", [1, 40, 10**9])
def test_lines_like_brute_force_whichever_hashes_are_hot(spark, rows, hot_rows):
    docs = spark.createDataFrame(
        [(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, keep string, h1 int, position int"
    ).repartition(4)
    assert found_by_op(docs, hot_rows=hot_rows) == brute_force(rows)


def test_other_limits(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_by_op(docs, least_docs=60, least_length=21) == brute_force(rows, 21, 60)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert found_by_op(docs) == []


def test_bitmaps_hold_only_words_with_dropped_lines(spark):
    many = "\n".join(f"filler line of document one, number {n:04d}" for n in range(500))
    shared = "a line found in three documents"
    docs = spark.createDataFrame(
        [(1, many + "\n" + shared), (2, shared), (3, shared)], "doc_id long, text string"
    )
    found = {r.doc_id: r for r in lines.keep_bitmaps(docs).collect()}
    assert [(w.word, w.bits) for w in found[1].keep] == [(500 // 64, ~(1 << (500 % 64)))]
    assert found[3].keep == [] and found[2].n_dropped == 1


def test_one_range_shuffle_serves_the_ordered_pass(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = lines.materialize(lines.line_hashes(docs), "test-hashes")
    plan = lines._judged_in_order(hashes, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


def test_registered_query_and_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf_dir), sf_dir, "op11_line_dedup").startswith("MATCH")
