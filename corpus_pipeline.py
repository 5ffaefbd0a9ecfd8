"""The corpus pipeline: documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doccluster.llm.decontamination import drop_contaminated
from doccluster.llm.packing import packed_digest
from doccluster.llm.secrets import redact
from doccluster.llm.simhash import keep_one
from doccluster.llm.toxicity import drop_toxic, fit
from doccluster.sources.scratch import materialize, setting

# Characters and words that a worker holds while it packs.
SLICE_CHARS = 500_000
MOST_WORDS = 60_000
# Rows that a worker is handed at once where whole texts go to Python and a stage
# writes what comes back.
ROWS_AT_ONCE = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts, null ids and repeated rows: the text alone decides,
    and a null or empty one stays.
    """
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest id.

    Null ids count as largest; of repeated rows one stays. Null and empty texts
    are one group, the one of the fingerprint zero.
    """
    with setting(spark, *ROWS_AT_ONCE):
        return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay, as do null ids and repeated rows
    without a window. An empty benchmark removes nothing.
    """
    with setting(spark, *ROWS_AT_ONCE):
        return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark.

    Null texts stay null; repeated rows and null ids stay.
    """
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in the packed sequences.

    Null and empty texts are one piece of one token; repeated rows and null ids
    are documents of their own. The workers keep what earlier stages loaded, so
    this one is asked to hold fewer words at a time.
    """
    with setting(spark, *ROWS_AT_ONCE):
        return packed_digest(docs, slice_chars=SLICE_CHARS, most_words=MOST_WORDS)


# Names of a table's own columns are free: no stage overwrites one, and empty
# tables give empty ones.
STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
