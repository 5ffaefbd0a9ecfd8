"""Tables whose columns have the names that operators use for their own."""

from doccluster.llm.columns import unused
from doccluster.llm.decontamination import drop_contaminated
from doccluster.llm.secrets import redact
from doccluster.llm.simhash import keep_one
from doccluster.llm.url_filters import filter_urls

SCHEMA = "doc_id long, text string, _uid long, _text string, fp string, domain string, segment int"
LONG = "one two three four five six seven eight nine ten eleven"


def rows():
    return [
        (1, LONG, 77, "a", "f", "d", 1),
        (2, LONG, 88, "b", "f", "d", 1),
        (None, None, 99, None, None, None, None),
        (3, "", 98, "", "", "", 0),
        (4, "password = hunter2hunter2", 5, "x", "y", "z", 2),
        (4, "password = hunter2hunter2", 5, "x", "y", "z", 2),
    ]


def test_helper_names_avoid_the_columns_of_a_table(spark):
    df = spark.createDataFrame([(1, 2)], "_UID int, __uid int")
    assert unused(df, "_uid") == "___uid" and unused(df, "x") == "x"


def test_stages_give_back_all_columns(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(2)
    given = set(rows())
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert set(got) <= given and sorted(r[2] for r in got if r[2] not in (98, 99)) == [5, 77]
    items = spark.createDataFrame([(1, LONG), (2, None), (None, "")], "item_id long, text string")
    clean = drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r[2] for r in map(tuple, clean.collect())) == [5, 5, 98, 99]
    masked = redact(docs)
    assert masked.columns == docs.columns
    got = {r._uid: r.text for r in masked.collect()}
    assert got[99] is None and got[98] == "" and got[77] == LONG and "hunter2" not in got[5]


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (keep_one(docs), drop_contaminated(docs, items), redact(docs)):
        assert out.columns == docs.columns and out.collect() == []


def test_captures_with_the_columns_of_entries(spark):
    captures = spark.createDataFrame(
        [("a.b.example", 5, "mine", "x"), (None, 5, "mine", "y")],
        "host string, day int, domain string, action string",
    )
    entries = spark.createDataFrame([("b.example", 2, "block")], "domain string, day int, action string")
    found = {r.action: r for r in filter_urls(captures, entries).collect()}
    assert found["x"].domain == "mine" and found["x"]._domain == "b.example"
    assert found["x"]._action == "block" and found["y"]._action is None
