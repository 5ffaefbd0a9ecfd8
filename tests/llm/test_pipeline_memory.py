"""What a worker of the pipeline is handed and holds at once; results stay the same."""

import pytest

import corpus_pipeline
from doccluster.llm.packing import packed_digest

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize(
    "stage, step",
    [
        ("near_dedup", "keep_one"),
        ("decontamination", "drop_contaminated"),
        ("best_fit_packing", "packed_digest"),
    ],
)
def test_written_texts_go_to_python_a_thousand_at_a_time(spark, tmp_path, monkeypatch, stage, step):
    seen = []

    def recorded(docs, *args, **options):
        seen.append(int(spark.conf.get(ROWS)))
        return docs

    monkeypatch.setattr(corpus_pipeline, step, recorded)
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    docs.withColumnRenamed("doc_id", "item_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.conf.get(ROWS)
    dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert seen == [1000]
    assert spark.conf.get(ROWS) == before


def test_packing_in_small_slices_gives_the_same_pieces(spark):
    texts = [None, "", *(f"word{n} Word{n}, and {n % 7}. " * (n % 40) for n in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = packed_digest(docs).select(columns)
    small = packed_digest(docs, slice_chars=2_000, most_words=20).select(columns)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, whole.collect()))
