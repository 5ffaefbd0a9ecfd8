import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doccluster.llm import packing

WORDS = "foo Foo É ΣΑΣ İx a. b, c.. don't. 's x'LL 12 3. <|endoftext|> <|ENDOFTEXT|> é %%% ß ﬁ. 日本 😀".split()
SPACES = [" ", "\n", "\t", " ", " ", "\x0b", "　", ""]


@pytest.fixture(scope="module")
def tokenizer():
    return packing.load_tokenizer(packing.VOCABULARY)


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def test_word_by_word_ids_equal_whole_texts(tokenizer):
    rng = random.Random(1)
    texts = [
        "".join(rng.choice(WORDS) + rng.choice(SPACES) for _ in range(rng.randint(0, 9))) for _ in range(3000)
    ]
    ids, counts = packing.encode_texts(pa.array([*texts, None]), packing.WordIds(tokenizer))
    ends = np.cumsum(counts)
    for text, end, count in zip([*texts, None], ends, counts):
        assert ids[end - count : end].tolist() == plain_ids(tokenizer, text)[:-1]


def test_best_fit_and_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        where, offset = packing.best_fit_decreasing(lengths, 100)
        for number in range(where.max() + 1):
            mine = sorted(zip(offset[where == number], lengths[where == number]))
            assert mine[0][0] == 0 and sum(n for _, n in mine) <= 100
            assert all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:]))
        assert packing.lower_bound(lengths, 100) <= where.max() + 1
    # three of just over a half need three sequences, which the sum alone does not show
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3
    assert packing.lower_bound(np.array([34] * 6), 100) == 3


def test_groups_exchange_until_one_is_left(spark):
    rng = np.random.default_rng(2)
    lengths = [int(n) for n in rng.integers(1, 101, 3000)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "uid bigint, length bigint")
    packed = packing.pack_lengths(pieces, 100, group_rows=100, exchange=4).collect()
    assert sorted(r.uid for r in packed) == list(range(3000))
    filled = {}
    for r in sorted(packed, key=lambda r: r.offset):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + lengths[r.uid]
    assert max(filled.values()) <= 100
    least = packing.lower_bound(np.array(lengths), 100)
    # a group of a hundred pieces packs worse than all of them together
    assert least <= len(filled) <= 1.04 * least


def test_gaps_close_by_exchange(spark, caplog):
    # the bound of all pieces is 40: every 60 meets a 40. Dealt to ten groups by hash they do not.
    lengths = [60] * 40 + [40] * 40
    pieces = spark.createDataFrame(list(enumerate(lengths)), "uid bigint, length bigint")
    with caplog.at_level("INFO", logger=packing.__name__):
        packed = packing.pack_lengths(pieces, 100, group_rows=8, exchange=10)
    assert packing.least_sequences(pieces, 100) == 40
    number = [r.args[2] for r in caplog.records]
    assert len({r.sequence_id for r in packed.collect()}) == number[-1] < number[0]


def test_certified_groups_keep_their_sequences():
    where = np.array([0, 0, 1, 2, 2, 3])
    used = np.array([100, 70, 60, 90])
    keep = packing._handed_over(where, used, 100, True, 100)
    assert keep.tolist() == [False, False, True, False]
    gap = packing._handed_over(where, used, 100, False, 3)
    assert gap.tolist() == [False, True, True, False]
    assert not packing._handed_over(np.array([0]), np.array([100]), 100, False, 9).any()


def test_pack_documents(spark, tokenizer):
    texts = [None, "", "hello world", "hello world", "word " * 5000, "x" * 9000]
    rows = [(n, t, n) for n, t in enumerate(texts)] + [(3, texts[3], 0), (None, "null id", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece int")
    found = packing.pack_documents(docs)
    cached = found.collect()
    by_doc = {}
    for r in cached:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, bytes(r.ids)))
    for doc_id, text, _ in rows:
        ids = np.array(plain_ids(tokenizer, text), "<u4")
        pieces = [
            (n, min(2048, len(ids) - n), ids[n : n + 2048].tobytes()) for n in range(0, len(ids), 2048)
        ]
        assert sorted(by_doc[doc_id]) == sorted(pieces * (2 if doc_id == 3 else 1))
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(found).collect()}
    for r in cached:
        at = 4 * r.offset
        assert whole[r.sequence_id][at : at + 4 * r.length] == bytes(r.ids)
    digest = packing.packed_digest(docs).collect()
    assert sorted(r.ids_crc32 for r in digest) == sorted(zlib.crc32(bytes(r.ids)) for r in cached)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_documents(docs, {"n": F.length("ids")}).count() == 0
