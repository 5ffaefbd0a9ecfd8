import time

import pytest

from doccluster.plans import jobs
from doccluster.sources import readers, scratch, writers


@pytest.fixture
def lines(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return write


def test_docs_drop_and_list_malformed_lines(spark, lines):
    path = lines("docs", "1 one two\n2 \nthree four\n5\n\n7 a  b\n")
    rows = [tuple(r) for r in readers.read_docs(spark, path, min_partitions=3).collect()]
    assert sorted(rows) == [(1, "one two"), (2, ""), (7, "a  b")]
    assert sorted(r.value for r in readers.malformed_lines(spark, path).collect()) == [
        "", "5", "three four",
    ]


def test_categorized_docs(spark, lines):
    path = lines("docs", "news 1 one two\nnews x y\nsport 2\n")
    rows = [tuple(r) for r in readers.read_categorized_docs(spark, path).collect()]
    assert rows == [("news", 1, "one two")]
    assert readers.malformed_lines(spark, path, categorized=True).count() == 2


def test_gold_skips_the_first_line_of_each_file(spark, tmp_path):
    (tmp_path / "a").write_text('docid label\n1 "quoted label\n2 two words\n')
    (tmp_path / "b").write_text("anything\n3 x\n")
    rows = {r.doc_id: r.label for r in readers.read_gold(spark, str(tmp_path)).collect()}
    assert rows == {1: '"quoted label', 2: "two words", 3: "x"}


def test_tags(spark, lines):
    assert [r.label for r in readers.read_tags(spark, lines("tags", "a b\nc\n")).collect()] == [
        "a b", "c",
    ]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "cate string, n int")
    writers.write_overwrite(df, path)
    writers.write_by_category(df, path)
    assert sorted(p.name for p in (tmp_path / "out").glob("cate=*")) == ["cate=a", "cate=b"]
    assert spark.read.parquet(path).count() == 3
    report = str(tmp_path / "report")
    writers.append_report(df.limit(1), report)
    writers.append_report(df.limit(1), report)
    assert [r.value for r in spark.read.text(report).collect()] == ["a\t1", "a\t1"]


class Session:
    """The two settings scratch reads."""

    def __init__(self, master, named=None, of_context=None):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master, self.applicationId = master, f"app-{master}"
        self.getCheckpointDir = lambda: of_context


def test_scratch_root_is_the_named_folder():
    assert scratch.checkpoint_root(Session("yarn", "hdfs://x/ck/")) == "hdfs://x/ck"
    assert scratch.checkpoint_root(Session("yarn", None, "hdfs://y/ck")) == "hdfs://y/ck"
    with pytest.raises(RuntimeError):
        scratch.checkpoint_root(Session("yarn"))
    assert scratch.checkpoint_root(Session("local[2]")) == scratch.checkpoint_root(Session("local[2]"))


def test_materialized_table_reads_back(spark):
    df = scratch.materialize(spark.range(3), "numbers")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2]
    assert all("/doccluster/numbers-" in f for f in df.inputFiles())


def test_report_lines_keep_all_columns(spark, tmp_path):
    path = str(tmp_path / "report")
    df = spark.createDataFrame([("c", None, 2, None)], "a string, b double, n int, t string")
    writers.append_report(df, path)
    assert [r.value for r in spark.read.text(path).collect()] == ["c\tNaN\t2\t"]


def test_a_job_leaves_no_scratch_tables(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "checkpoint_root", lambda _: str(tmp_path / "scratch"))
    docs = docs_of({n: f"{'red green' if n % 2 else 'blue grey'} w{n % 4}" for n in range(8)})
    jobs.write_ap_clusters(docs, str(tmp_path / "out"), "C", "auto", 2, top_n=3)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    assert not any((tmp_path / "scratch" / "doccluster").iterdir())


def test_report_of_a_named_run_is_replaced(spark, tmp_path):
    path = str(tmp_path / "report")
    df = spark.createDataFrame([(1, None), (2, 0.5)], "n int, score double")
    for run, rows in (("a/1", df), ("b", df.limit(1)), ("a/1", df)):
        writers.append_report(rows, path, run)
    lines = spark.read.text(path).groupBy("run").count().collect()
    assert {r.run: r["count"] for r in lines} == {"a/1": 2, "b": 1}
    assert {r.value for r in spark.read.text(path).filter("run = 'a/1'").collect()} == {"1\tNaN", "2\t0.5"}


def test_shuffle_files_of_a_written_table_go_with_the_write(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
    files = blocks.diskBlockManager().getAllFiles
    before, setting = files().size(), spark.conf.get(scratch.CLEANUP, None)
    written = scratch.materialize(spark.range(5000).selectExpr("id % 7 as n").groupBy("n").count(), "n")
    end = time.time() + 10
    while files().size() > before and time.time() < end:
        time.sleep(0.1)
    assert files().size() <= before and spark.conf.get(scratch.CLEANUP, None) == setting
    assert written.count() == 7
