"""Benchmark decontamination with a positional inverted index.

The corpus is indexed in segments of bounded size: every term of a segment has
one posting with its positions, and documents of a segment lie one after the
other, a gap apart. A phrase is found by intersecting offset-adjusted posting
lists, from the phrase's rarest term on. Query phrases come in blocks of
bounded size, each sent to all segments, so a larger benchmark means more
blocks and not a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doccluster.llm.columns import unused
from doccluster.sources.scratch import materialize, scratch_path

WINDOW = 10
# Text bytes per segment, phrases per block, and candidate places per step.
SEGMENT_BYTES = 12_000_000
BLOCK_PHRASES = 50_000
STEP_PLACES = 4_000_000
# Positions between two documents; longer phrases or slops are refused.
GAP = 64
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
TO_BLANK = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))
INDEX = "segment bigint, term string, postings binary, ids array<bigint>, words array<bigint>"


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and non-ASCII characters."""
    return (text or b"").lower().translate(TO_BLANK).split()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Segment:
    """Documents gathered for one segment of the index."""

    def __init__(self) -> None:
        self.vocabulary, self.ids, self.tokens, self.size = _Vocabulary(), [], [], 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        words = words_of(text)
        self.ids.append(doc_id)
        self.tokens.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words)))
        self.size += len(text or b"") + 1

    def rows(self, number: int) -> pa.RecordBatch:
        """One row per term, and a last one, without a term, for the documents."""
        counts = np.array([len(t) for t in self.tokens], np.int64)
        tokens = np.concatenate(self.tokens)
        position = np.arange(len(tokens)) + np.repeat(np.arange(len(counts)) * GAP, counts)
        order = np.argsort(tokens, kind="stable")
        position = position[order]
        sizes = np.bincount(tokens, minlength=len(self.vocabulary))
        ends = np.cumsum(sizes)
        gaps = np.diff(position, prepend=0)
        first = ends - sizes
        gaps[first] = position[first]
        offsets = np.concatenate([[0], ends, ends[-1:] if len(ends) else [0]]).astype(np.int32) * 4
        terms = len(self.vocabulary)
        postings = pa.Array.from_buffers(
            pa.binary(),
            terms + 1,
            [None, pa.py_buffer(offsets), pa.py_buffer(gaps.astype("<u4"))],
        )
        names = pa.array([*self.vocabulary, None], pa.binary()).cast(pa.string())
        listed = pa.array([*[None] * terms, self.ids], pa.list_(pa.int64()))
        words = pa.array([*[None] * terms, counts], pa.list_(pa.int64()))
        segment = pa.array(np.full(terms + 1, number))
        return pa.RecordBatch.from_arrays(
            [segment, names, postings, listed, words], ["segment", "term", "postings", "ids", "words"]
        )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index of ``docs``: postings per segment and term.

    Postings hold the gaps between positions as 32-bit words. A segment has
    one row with a null ``term``, which lists its documents and their numbers
    of words. Null texts have no words; null ids and repeated rows are listed
    like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, segment = TaskContext.get().partitionId() << 32, _Segment()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                segment.add(doc_id, text.as_py())
                if segment.size >= SEGMENT_BYTES:
                    yield segment.rows(number)
                    number, segment = number + 1, _Segment()
                    pa.default_memory_pool().release_unused()
        if segment.ids:
            yield segment.rows(number)

    picked = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary"))
    path = scratch_path(docs.sparkSession, "postings")
    picked.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def documents_of(index: DataFrame) -> DataFrame:
    """``(segment, place, doc_id, n_words)`` of every indexed row."""
    both = F.posexplode(F.arrays_zip("ids", "words"))
    return (
        index.filter("term IS NULL")
        .select("segment", both.alias("place", "both"))
        .select(
            "segment", "place", F.col("both.ids").alias("doc_id"), F.col("both.words").alias("n_words")
        )
    )


def word_list(text: Column) -> Column:
    """The words of :func:`words_of` as a column."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = F.split(
        F.translate(text, upper, upper.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    )
    return F.filter(parts, lambda w: w != "")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, terms)``: all windows of ``WINDOW`` words; of a shorter item,
    all its words. Null texts and texts without words have none."""
    listed = items.select(F.col(id_col).alias("item_id"), word_list(F.col(text_col)).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1)))
    return listed.filter("size(words) > 0").select(
        "item_id",
        F.explode(F.transform(starts, lambda n: F.slice("words", n, WINDOW))).alias("terms"),
    )


class Phrases:
    """A block of phrases over their own small vocabulary."""

    def __init__(self, ids: list[int], terms: list[list[str]], frequency: dict[str, int]) -> None:
        known = [(i, t) for i, t in zip(ids, terms) if all(w in frequency for w in t)]
        vocabulary = sorted({w for _, t in known for w in t})
        self.number = {w: n for n, w in enumerate(vocabulary)}
        self.ids = np.array([i for i, _ in known], np.int64)
        self.length = np.array([len(t) for _, t in known], np.int64)
        width = int(self.length.max()) if known else 0
        # per phrase its terms and their offsets, rarest term first
        self.term = np.zeros((len(known), width), np.int64)
        self.offset = np.zeros((len(known), width), np.int64)
        for row, (_, t) in enumerate(known):
            order = sorted(range(len(t)), key=lambda n: (frequency[t[n]], n))
            self.term[row, : len(t)] = [self.number[t[n]] for n in order]
            self.offset[row, : len(t)] = order


def _places(key: np.ndarray, first: np.ndarray, size: np.ndarray, phrases: Phrases):
    """Blocks of (phrase, start) where the phrase's rarest term stands."""
    many = size[phrases.term[:, 0]]
    for block in np.split(
        np.arange(len(many)), np.flatnonzero(np.diff(np.cumsum(many) // STEP_PLACES)) + 1
    ):
        total = int(many[block].sum())
        if total:
            row = np.repeat(block, many[block])
            before = np.cumsum(many[block]) - many[block]
            at = np.repeat(first[phrases.term[block, 0]] - before, many[block]) + np.arange(total)
            yield row, (key[at] & 0xFFFFFFFF) - phrases.offset[row, 0]


def find_phrases(
    terms: list[str], postings: list[bytes], phrases: Phrases, slop: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """``(phrase, start)`` of all occurrences in one segment.

    With ``slop`` each term may stand up to that many words from its place
    relative to the rarest term, and ``start`` is where the phrase would start,
    before its document perhaps.
    """
    number = [phrases.number[t] for t in terms]
    order = np.argsort(number)
    lists = [np.cumsum(np.frombuffer(postings[n], "<u4").astype(np.int64)) for n in order]
    size = np.zeros(len(phrases.number), np.int64)
    size[np.array(number, np.int64)[order]] = [len(x) for x in lists]
    first = np.cumsum(size) - size
    key = np.concatenate([np.empty(0, np.int64), *lists]) | np.repeat(
        np.arange(len(size)) << 32, size
    )
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for row, start in _places(key, first, size, phrases):
        for step in range(1, phrases.term.shape[1]):
            asked = phrases.length[row] > step
            at = start + phrases.offset[row, step]
            base = phrases.term[row, step] << 32
            low = np.searchsorted(key, base + np.maximum(at - slop, 0))
            hit = ~asked
            inside = low < len(key)
            hit[inside] |= key[low[inside]] <= (base + at + slop)[inside]
            row, start = row[hit], start[hit]
        found.append((row, start))
    return tuple(np.concatenate(x) for x in zip(*found))


def _blocks(wanted: DataFrame) -> Iterator[tuple[list[int], list[list[str]]]]:
    """The written table ``(window_id, terms)`` in blocks of bounded size."""
    count = max(1, -(-wanted.count() // BLOCK_PHRASES))
    for block in range(count):
        rows = wanted.filter(F.pmod("window_id", F.lit(count)) == block).collect()
        yield [r.window_id for r in rows], [r.terms for r in rows]


def phrase_matches(index: DataFrame, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """``(segment, place, window_id, start, length)`` of all occurrences.

    ``wanted`` is a written table ``(window_id, terms)``, distinct. ``place``
    and ``start`` tell the document within the segment and the word within it.
    ``slop`` above 0 gives proximity matches, see :func:`find_phrases`.
    """
    spark = index.sparkSession
    if WINDOW + slop > GAP:
        raise ValueError(f"phrases with their slop must fit into {GAP} words")
    vocabulary = materialize(wanted.select(F.explode("terms").alias("term")).distinct(), "terms")
    # postings of the asked terms, and the lists of documents
    asked = materialize(
        index.join(vocabulary, "term", "left_semi")
        .select("segment", "term", "postings", F.lit(None).cast("array<bigint>").alias("words"))
        .unionByName(
            index.filter("term IS NULL").select("segment", "term", "postings", "words")
        ),
        "asked",
    )
    frequency = materialize(
        asked.filter("term IS NOT NULL")
        .groupBy("term")
        .agg(F.sum(F.length("postings") / 4).cast("bigint").alias("n")),
        "frequency",
    )
    schema = "segment bigint, place int, window_id bigint, start bigint, length bigint"
    found = spark.createDataFrame([], schema)
    for ids, terms in _blocks(wanted):
        used = spark.createDataFrame([(w,) for w in {w for t in terms for w in t}], "term string")
        counts = {r.term: r.n for r in frequency.join(used, "term").collect()}
        phrases = Phrases(ids, terms, counts)

        if len(phrases.ids):
            found = found.unionByName(
                asked.groupBy("segment").applyInPandas(_segment_search(phrases, slop), schema)
            )
    return found


def _segment_search(phrases: Phrases, slop: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        listed = pdf["term"].isna()
        words = np.asarray(pdf.loc[listed, "words"].iloc[0], np.int64)
        rows = pdf[~listed & pdf["term"].isin(phrases.number)]
        row, start = find_phrases(rows["term"].tolist(), rows["postings"].tolist(), phrases, slop)
        base = np.cumsum(words) - words + np.arange(len(words)) * GAP
        anchor = start + phrases.offset[row, 0]
        place = np.searchsorted(base, anchor, "right") - 1
        return pd.DataFrame(
            {
                "segment": pdf["segment"].iloc[0],
                "place": place.astype(np.int32),
                "window_id": phrases.ids[row],
                "start": start - base[place],
                "length": phrases.length[row],
            }
        )

    return search


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items)`` for every row of ``docs``.

    A word is hit if it lies in an occurrence of a window of an item; ``items``
    lists the ids of the items with such windows as sorted strings. Items with
    a null id count for hits and are listed as an empty string. A table without
    items leaves every document without hits.
    """
    index = build_index(docs, id_col, text_col)
    owned = materialize(
        windows(items, item_col, item_text_col)
        .select(
            F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "terms"
        )
        .distinct(),
        "windows",
    )
    # numbered once they are written, by their terms and not by a hash of them
    wanted = materialize(
        owned.select("terms").distinct().withColumn("window_id", F.monotonically_increasing_id()),
        "wanted",
    )
    owned = owned.join(wanted, "terms").select("window_id", "item")
    matches = materialize(phrase_matches(index, wanted), "matches")
    key = ["segment", "place"]
    # end of the words counted so far, and their number, along the sorted spans
    ends = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end")))),
        F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("hit")),
        lambda done, span: F.struct(
            F.greatest(done["end"], span["end"]).alias("end"),
            (
                done["hit"]
                + F.greatest(F.lit(0).cast("bigint"), span["end"] - F.greatest(done["end"], span["start"]))
            ).alias("hit"),
        ),
    )
    hits = matches.groupBy(*key).agg(ends["hit"].alias("n_hit"))
    named = (
        matches.select(*key, "window_id")
        .distinct()
        .join(owned.select("window_id", "item"), "window_id")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    both = materialize(hits.join(named, key), "hits")
    none = F.array().cast("array<string>")
    return documents_of(index).join(both, key, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.coalesce("items", none).alias("items"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    found = contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of an item.

    All columns stay, whatever their names; null and empty texts hold no window.
    """
    uid = unused(docs, "_uid")
    numbered = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    found = contamination(
        numbered.select(F.col(uid).alias("_uid"), F.col(text_col).alias("_text")),
        items,
        "_uid",
        "_text",
    )
    hit = materialize(found.filter("n_hit > 0").select(F.col("doc_id").alias(uid)), "hit")
    return numbered.join(hit, uid, "left_anti").select(*docs.columns)


def _sql_words(text: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '{pattern}')"


OP7_SQL = f"""
WITH doc AS (SELECT doc_id, {_sql_words('text')} AS l FROM documents),
item AS (SELECT item_id, {_sql_words('text')} AS l FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(l[n:n + 9], ' ') AS t, least(len(l), 10) AS k
  FROM (SELECT item_id, l, unnest(range(1, greatest(len(l) - 9, 1) + 1)) AS n FROM item WHERE len(l) > 0)
), place AS (
  SELECT doc_id, k, unnest(list_transform(range(1, len(l) - k + 2), lambda n: array_to_string(l[n:n + k - 1], ' '))) AS t,
         unnest(range(1, len(l) - k + 2)) AS n
  FROM doc, (SELECT DISTINCT k FROM win)
), hit AS (
  SELECT p.doc_id, p.n, p.k, w.item_id FROM place p JOIN win w ON w.k = p.k AND w.t = p.t
), counted AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit
  FROM (SELECT doc_id, unnest(range(n, n + k)) AS x FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.l)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN counted c ON c.doc_id = d.doc_id LEFT JOIN named i ON i.doc_id = d.doc_id
"""
