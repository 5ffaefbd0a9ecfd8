import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from doccluster.llm import simhash
from doccluster.llm.components import components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def near_values(count, seed=3):
    rng = np.random.default_rng(seed)
    values = set()
    for _ in range(count // 5):
        value = int(rng.integers(0, 2**63))
        for _ in range(5):
            values.add(value)
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                value ^= 1 << int(bit)
    return sorted(values)


def test_fingerprints():
    for text in ["", None, " \t", "One", "one TWO", "Ä b c d  e f", "a b c " * 50]:
        assert simhash.fingerprint(text and text.encode()) % 2**64 == plain_fingerprint(text)
    long = " ".join(str(n) for n in range(70_000))
    assert simhash.fingerprint(long.encode()) % 2**64 == plain_fingerprint(long)


def test_forest_finds_all_pairs():
    values = np.array(near_values(300), np.uint64)
    forest = simhash.Forest(np.zeros(len(values), np.int64), values)
    a, b = forest.search(np.arange(len(values)), 2)
    found = {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    gaps = np.bitwise_count(values[:, None] ^ values[None, :])
    assert found == {(i, j) for i, j in zip(*np.nonzero(gaps <= 2)) if i > j}


def linked_classes(spark, values):
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    roots = {r.node % 2**64: r.root % 2**64 for r in components(simhash.links(table)).collect()}
    classes = {}
    for v in values:
        classes.setdefault(roots.get(v, v), set()).add(v)
    return sorted(map(sorted, classes.values()))


def expected_classes(values):
    classes = {}
    for v, root in plain_components(values).items():
        classes.setdefault(root, set()).add(v)
    return sorted(map(sorted, classes.values()))


def test_links_connect_what_is_near(spark):
    values = near_values(200) + [0, 1, 2**64 - 1]
    assert linked_classes(spark, values) == expected_classes(values)


def test_crowded_shards_are_divided(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 2)
    monkeypatch.setattr(simhash, "CHUNK_ROWS", 50)
    values = sorted({(7 << 40) | v for v in near_values(60)} | {v & 0xFFFFFFFF for v in near_values(60, 9)})
    assert linked_classes(spark, values) == expected_classes(values)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {**{n: 0 for n in range(1, 41)}, 101: 100}


def corpus(spark):
    text = " ".join(f"w{n}" for n in range(300))
    rows = [
        (5, text, "x"), (3, text.upper(), "x"), (9, "another text of some words here", "x"), (None, text, "x"),
        (11, None, "x"), (12, "", "x"), (None, "only null ids here", "x"), (None, "only null ids here", "x"),
        (9, "another text of some words here", "x"),
    ]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, fp string")


def test_near_duplicates(spark):
    rows, docs = corpus(spark)
    found = simhash.near_duplicates(docs)
    got = sorted((repr((r.doc_id, r.fp % 2**64, r.component_id)) for r in found.collect()))
    smallest = {}
    for doc_id, text, _ in rows:
        value = plain_fingerprint(text)
        smallest[value] = min((x for x in (smallest.get(value), doc_id) if x is not None), default=None)
    assert got == sorted(repr((d, plain_fingerprint(t), smallest[plain_fingerprint(t)])) for d, t, _ in rows)


def test_one_of_each_group_stays(spark):
    _, docs = corpus(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([3, 9, 11, None], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.filter(F.lit(False))).count() == 0
