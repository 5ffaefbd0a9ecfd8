"""Secret scans by one combined deterministic automaton over all rules."""

from __future__ import annotations

import functools

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doccluster.llm.automaton import Rule, Scanner

# --- fixed values -----------------------------------------------------------
# Runs of a class are maximal, so a least length may stand in the pattern where
# a shorter match cannot use up text that a later one needs (access, hex). An
# assignment with a short value does use up its text: it is matched, then dropped.
RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        min_tail=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# ----------------------------------------------------------------------------
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
MASK = "[SECRET]"
# Texts that are Python strings at the same time.
BATCH_ROWS = 256


@functools.cache
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def text_spans(scanner: Scanner, text: str | None) -> list[tuple[str, int, int]]:
    """Spans of one text in code points; none for a null or empty text."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    found = scanner.scan(data)
    if len(data) == len(text) or not found:
        return [(scanner.rules[r].name, s, e) for s, r, e in found]
    points = {}
    last = count = 0
    for offset in sorted({o for s, _, e in found for o in (s, e)}):
        count += sum(b & 0xC0 != 0x80 for b in data[last:offset])
        last, points[offset] = offset, count
    return [(scanner.rules[r].name, points[s], points[e]) for s, r, e in found]


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Column of all rules' spans, by start and then in the order of the rules."""
    scanner = scanner_of(rules)

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [{"kind": k, "start": s, "end": e} for k, s, e in text_spans(scanner, t)]
                for t in texts
            ],
            dtype=object,
        )

    return scan(text)


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``(doc_id, spans)`` for every row of ``docs``.

    Repeated rows and rows with a null id stay rows of their own; a null text
    counts as empty and has no spans. Other columns are not read.
    """
    return docs.select(
        F.col(id_col).alias("doc_id"), secret_spans(F.col(text_col), rules).alias("spans")
    )


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span in the text replaced by a mark; all rows stay.

    Overlapping spans are replaced by one mark. Null texts stay null. A column
    ``n_chars``, where there is one, is counted anew for changed texts.
    """
    scanner = scanner_of(rules)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        parts = []
        for low in range(0, len(texts), BATCH_ROWS):
            some = texts.slice(low, BATCH_ROWS).to_pylist()
            parts.append(pa.array([masked(t, text_spans(scanner, t)) for t in some], pa.string()))
        out = pa.concat_arrays(parts) if parts else texts
        # the worker stays for other tasks and stages, its buffers need not
        del parts
        pa.default_memory_pool().release_unused()
        return out

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length(text_col).cast(kind))
    return out.select(*docs.columns)


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the base spans of every document."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[count(r.name).alias(f"n_{r.name}") for r in RULES],
        F.sha2(joined(F.col("spans")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
