import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from doccluster.llm import alignment

WORDS = "foo Foo É ΣΑΣ x a. b, don't 's 12345 <|endoftext|> </s> <0x41> ▁ é % ß ﬁ 日本語 😀 naïve aaaaaaaaaa".split()
SPACES = [" ", " ", "\n", "\t", "  ", "   ", "\x0b", "　", "", "\n\n", "\x85", "\x00"]


@pytest.fixture(scope="module")
def tokenizers():
    names = (alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    return [alignment.tokenizer_of(name) for name in names]


def cuts(tokens, text):
    """Byte ranges of the tokens of one text, or none if its bytes are not given back."""
    ids = tokens.encode([text])[0]
    pieces = [tokens.bytes[i] for i in ids]
    if b"".join(pieces) != (" " + text).encode():
        return None
    ends = np.cumsum([len(p) for p in pieces]).tolist()
    return [(i, s, e) for i, s, e in zip(ids, [0, *ends], ends)]


def plain_alignment(text, a, b):
    """Groups of one text, token by token."""
    found = [cuts(t, text) for t in (a, b)] if text else [None]
    if any(f is None for f in found):
        return None
    ends = sorted({e for *_, e in found[0]} & {e for *_, e in found[1]})
    groups, start = [], 0
    for end in ends:
        groups.append([[i for i, s, e in side if start <= s and e <= end] for side in found])
        start = end
    return groups


def brute_force(rows, a, b):
    groups = [plain_alignment(text, a, b) for _, text in rows]
    links = [
        Counter((x, y) for left, right in g or [] for x in left for y in right) for g in groups
    ]
    docs = Counter(pair for found in links for pair in found)
    highest = defaultdict(int)
    for (x, _), n in docs.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc_id, _), g, found in zip(rows, groups, links):
        listing = ";".join("|".join(",".join(map(str, s)) for s in group) for group in g or [])
        out.append(
            (
                doc_id,
                sum(len(s[0]) for s in g or []),
                sum(len(s[1]) for s in g or []),
                len(g or []),
                sum(found.values()),
                sum(n for p, n in found.items() if docs[p] == highest[p[0]]),
                sum(n * docs[p] for p, n in found.items()),
                hashlib.sha256(listing.encode()).hexdigest() if g else "",
            )
        )
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [
        "".join(rng.choice(WORDS) + rng.choice(SPACES) for _ in range(rng.randint(1, 40)))
        for _ in range(150)
    ]
    texts += [None, "", " ", "a", "a" * 3000, "long words " * 400, "\u0000", texts[0], texts[0]]
    return [(n if n % 7 else None, text) for n, text in enumerate(texts)] + [(3, texts[3])]


def test_diagonals_divide_the_merge_evenly_and_part_no_equal_ends():
    rng = np.random.default_rng(0)
    for size in (1, 2, 7, 50, 10**6):
        a, b = (np.unique(rng.integers(0, 400, n)) for n in (90, 150))
        pieces = [*alignment.merge_pieces(a, b, size)]
        assert np.concatenate([a[x] for x, _ in pieces]).tolist() == a.tolist()
        assert np.concatenate([b[y] for _, y in pieces]).tolist() == b.tolist()
        works = [len(a[x]) + len(b[y]) for x, y in pieces]
        assert max(works) <= size + 1
        common = np.concatenate([alignment.common_ends(a[x], b[y]) for x, y in pieces])
        assert common.tolist() == np.intersect1d(a, b).tolist()
        merged = np.sort(np.concatenate([a, b]))
        for x, y in pieces:
            if len(a[x]) and len(b[y]) and x.stop < len(a):
                assert max(a[x].max(), b[y].max()) <= a[x.stop]
        assert len(merged) == sum(works)


def test_groups_do_not_depend_on_the_pieces():
    rng = np.random.default_rng(1)
    a, b = (np.unique(np.append(rng.integers(1, 900, n), 900)) for n in (200, 300))
    whole = alignment.group_numbers(a, b, 10**6)
    for size in (1, 2, 3, 64):
        assert all((x == y).all() for x, y in zip(whole, alignment.group_numbers(a, b, size)))


@pytest.mark.parametrize("common,piece", [(0, 50), (40, 1 << 16), (1 << 19, 3)])
def test_documents_like_brute_force(spark, rows, tokenizers, common, piece):
    docs = spark.createDataFrame(
        [(d, t, 1, "x") for d, t in rows], "doc_id long, text string, row int, pairs string"
    ).repartition(3)
    found = alignment.align_documents(docs, most_common=common, piece=piece).drop("pairs", "times")
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(rows, *tokenizers)


def test_large_groups_are_expanded_by_distinct_ids():
    of_a, of_b = np.zeros(5000, np.int64), np.zeros(4000, np.int64)
    ids_a, ids_b = np.arange(5000) % 3, np.arange(4000) % 2
    parts = [*alignment.linked_pairs(of_a, ids_a, of_b, ids_b, 1)]
    assert sum(len(p[0]) for p in parts) == 6
    assert sum(int(p[2].sum()) for p in parts) == 5000 * 4000


def test_ids_equal_the_named_tokenizer(rows, tokenizers):
    import public_tokenizers
    from tokenizers import Tokenizer

    named = Tokenizer.from_file(public_tokenizers.path(alignment.VOCABULARY_A))
    named.encode_special_tokens = True
    texts = [text for _, text in rows if text]
    for text, ids in zip(texts, tokenizers[0].encode(texts)):
        assert named.encode(" " + text, add_special_tokens=False).ids == ids.tolist()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(docs).collect() == []


def test_registered_query_against_brute_force(spark, tokenizers):
    sf_dir = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    found = alignment.op12_cross_tokenizer_alignment(spark, sf_dir).collect()
    assert sorted(map(tuple, found), key=repr) == brute_force(rows, *tokenizers)
