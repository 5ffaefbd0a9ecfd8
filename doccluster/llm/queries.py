"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doccluster.llm.alignment import op12_cross_tokenizer_alignment
from doccluster.llm.decontamination import OP7_SQL, op7_benchmark_decontamination
from doccluster.llm.fixity import OP3_SQL, op3_warc_merkle_audit
from doccluster.llm.licenses import op8_license_scan
from doccluster.llm.lines import OP11_SQL, op11_line_dedup
from doccluster.llm.negatives import OP13_SQL, op13_hard_negatives
from doccluster.llm.neighbours import op4_nn_descent
from doccluster.llm.packing import op10_best_fit_packing
from doccluster.llm.secrets import op5_secret_scans
from doccluster.llm.sharding import op9_balanced_sharding
from doccluster.llm.simhash import op1_simhash_near_dedup
from doccluster.llm.toxicity import op2_toxicity
from doccluster.llm.url_filters import OP6_SQL, op6_temporal_url_filter

Query = Callable[[SparkSession, str], DataFrame]


def llm_queries() -> dict[str, Query]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_warc_merkle_audit": op3_warc_merkle_audit,
        "op4_nn_descent": op4_nn_descent,
        "op5_secret_scans": op5_secret_scans,
        "op6_temporal_url_filter": op6_temporal_url_filter,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_license_scan": op8_license_scan,
        "op9_balanced_sharding": op9_balanced_sharding,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_line_dedup": op11_line_dedup,
        "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
        "op13_hard_negatives": op13_hard_negatives,
    }


def llm_oracles() -> dict[str, str]:
    return {
        "op3_warc_merkle_audit": OP3_SQL,
        "op6_temporal_url_filter": OP6_SQL,
        "op7_benchmark_decontamination": OP7_SQL,
        "op11_line_dedup": OP11_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
