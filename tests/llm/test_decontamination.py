import re

import pytest
from pyspark.sql import functions as F

from doccluster.llm import decontamination as d
from doccluster.sources.scratch import materialize

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items):
    owned = {}
    for item, text in items:
        listed = words(text)
        for n in range(max(1, len(listed) - 9)) if listed else ():
            owned.setdefault(tuple(listed[n : n + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        listed, hit, found = words(text), set(), set()
        for window, ids in owned.items():
            for n in range(len(listed) - len(window) + 1):
                if tuple(listed[n : n + len(window)]) == window:
                    hit |= set(range(n, n + len(window)))
                    found |= ids
        out.append((doc_id, len(listed), len(hit), sorted(found)))
    return sorted(map(repr, out))


LONG = " ".join(f"t{n}" for n in range(25))
ITEMS = [(1, LONG), (2, "Short item!"), (2, "Short item!"), (10, "t3 t4 t5 t6 t7 t8 t9 t10 t11 t12"), (3, None), (4, "..."), (None, "null id item")]
DOCS = [
    (1, f"x y {LONG} z {LONG.upper()}"), (2, "a short, item; short item"), (3, None), (4, ""), (5, "SHORT"),
    (6, " ".join(f"t{n}" for n in range(4, 16))), (None, "a null id item"), (2, "a short, item; short item"),
    (7, "item short " * 3000 + "short-item"), (8, "t0 t1 t2 t3 t4 t5 t6 t7 t8"), (9, "übershort item Short ITEM"),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*r, "c") for r in DOCS], "doc_id bigint, text string, n_hit string")
    return docs.repartition(3), spark.createDataFrame(ITEMS, "item_id bigint, text string")


def got(found):
    return sorted(repr((r.doc_id, r.n_words, r.n_hit, list(r.items))) for r in found.collect())


def test_equals_brute_force(tables):
    assert got(d.contamination(*tables)) == brute_force(DOCS, ITEMS)


def test_small_segments_and_blocks(tables, monkeypatch):
    monkeypatch.setattr(d, "SEGMENT_BYTES", 60)
    monkeypatch.setattr(d, "BLOCK_PHRASES", 5)
    monkeypatch.setattr(d, "STEP_PLACES", 3)
    assert got(d.contamination(*tables)) == brute_force(DOCS, ITEMS)


def test_only_clean_rows_stay(tables):
    kept = d.drop_contaminated(*tables)
    assert kept.columns == tables[0].columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8]


def test_empty_tables(tables):
    docs, items = tables
    assert d.contamination(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in d.contamination(docs, items.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red green big blue"), (2, "green blue red"), (3, "red x x x x green")], "doc_id bigint, text string")
    wanted = materialize(spark.createDataFrame([(7, ["red", "green", "blue"])], "window_id bigint, terms array<string>"), "wanted")
    index = materialize(d.build_index(docs), "index")
    assert d.phrase_matches(index, wanted).count() == 0
    near = d.phrase_matches(index, wanted, slop=3).join(d.documents_of(index), ["segment", "place"])
    assert {r.doc_id for r in near.select("doc_id").collect()} == {1, 2}
    with pytest.raises(ValueError):
        d.phrase_matches(index, wanted, slop=60)
    assert index.filter(F.col("term") == "red").count() >= 1
