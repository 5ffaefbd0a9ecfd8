import pytest
from pyspark.sql import functions as F

from doccluster.functions.text import normalize_text, tokenize_filtered, tokenize_raw, with_bag
from doccluster.operators.stats import raw_bags

RAW = [
    ("Hello.", ["hello"]),
    ("(hello", ["", "hello"]),
    ("...", []),
    ("", [""]),
    (" \t\n", [""]),
    ("\n a  b c 3x\n", ["a", "b c", "x"]),
    ("A1B2", ["a", "b"]),
    (None, []),
]
FILTERED = [
    ("The re CATS, cats x 12", ["cats", "cats"]),
    ("don't won't", ["don", "won"]),
    ("\U00010400 é ab", ["\U00010428", "ab"]),
    (None, []),
]


def tokens(spark, text, tokenizer):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(tokenizer(F.col("text")).alias("t")).first().t


@pytest.mark.parametrize("text, expected", RAW)
def test_raw_tokens(spark, text, expected):
    assert tokens(spark, text, tokenize_raw) == expected


@pytest.mark.parametrize("text, expected", FILTERED)
def test_filtered_tokens(spark, text, expected):
    assert tokens(spark, text, tokenize_filtered) == expected


def test_normalized_text_keeps_end_spaces_of_punctuation(spark):
    df = spark.createDataFrame([("  (A, b!)  ",)], "text string")
    assert df.select(normalize_text(F.col("text"))).first()[0] == " a b "


def test_custom_stopwords(spark):
    def keep_all(text):
        return tokenize_filtered(text, stopwords=())

    assert tokens(spark, "the cat x", keep_all) == ["the", "cat"]


def test_bag_counts_runs_without_shuffle(spark):
    df = spark.createDataFrame([(1, "b a b c b a"), (2, "..."), (3, "z")], "id int, text string")
    bag = with_bag(df, tokenize_raw(F.col("text")), "id")
    rows = {r.id: (r.len, r.terms, r.counts) for r in bag.collect()}
    assert rows == {
        1: (6, ["a", "b", "c"], [2, 3, 1]),
        2: (0, [], []),
        3: (1, ["z"], [1]),
    }
    plan = bag._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_hashed_bags_merge_colliding_terms(docs_of):
    row = raw_bags(docs_of({1: "a b c d e f g h"}), num_features=2).first()
    assert row.len == 8 and sum(row.counts) == 8 and len(row.counts) <= 2
    assert row.norm2 == sum(c * c for c in row.counts)
