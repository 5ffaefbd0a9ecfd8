"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizers cut the same bytes. Each token has a byte end; where a token of
A and a token of B end together, the tokens since the last such place form a
group. The two sorted lists of ends are merged in pieces of equal work: a binary
search along each diagonal of the merge finds how many ends of either list lie
before it, so every piece is independent of the others, whatever documents it
holds or cuts. The common ends that a piece finds, and running totals of their
numbers, stitch the groups that cross the borders of pieces.

Linked id pairs are counted over the corpus and their counts are brought back
to the documents: a bounded number of the most frequent pairs by broadcast, all
others by a shuffle, so no pair is frequent enough there to burden a task.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doccluster.sources.scratch import materialize

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
# Ends of both lists in one piece of the merge.
PIECE = 1 << 16
# Characters tokenised at once, pairs expanded at once.
BATCH_CHARS = 1 << 20
EXPANSION = 1 << 20
# Groups of more links than this have their equal ids merged before they are expanded.
LARGE_GROUP = 64
# Id pairs that are broadcast, at most.
COMMON_PAIRS = 1 << 19
# A pair is one number: the id of A times this plus the id of B.
STRIDE = 1 << 20
ALIGNED = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint,"
    " groups_sha256 string, pairs array<bigint>, times array<bigint>"
)


# --- the two tokenizers -------------------------------------------------------


def _path(vocabulary: str) -> str:
    import public_tokenizers

    return vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte.

    Bytes that print stand for themselves, the others for letters from 256 on.
    """
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteTokens:
    """Byte-level BPE of a space and the text; special tokens in texts are plain text.

    The vocabulary is that of the file. Its ids are the ranks of its merges, so
    tiktoken, which is faster, cuts texts into the same tokens.
    """

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        from tiktoken import Encoding

        with open(_path(vocabulary), encoding="utf-8") as file:
            content = json.load(file)
        letters = _byte_letters()
        special = {token["id"] for token in content["added_tokens"]}
        known = {n: t for t, n in content["model"]["vocab"].items() if n not in special}
        pieces = {n: bytes(letters[c] for c in token) for n, token in known.items()}
        ranks = {piece: n for n, piece in pieces.items()}
        self.encoding = Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.bytes = [pieces.get(n, b"") for n in range(max(pieces) + 1)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encoding.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]


class PieceTokens:
    """Pieces of a SentencePiece model, which puts a space before the text itself."""

    def __init__(self, vocabulary: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=_path(vocabulary))
        self.bytes = [self._bytes(n) for n in range(self.model.get_piece_size())]

    def _bytes(self, number: int) -> bytes:
        piece = self.model.id_to_piece(number)
        if self.model.is_byte(number):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=4)
def tokenizer_of(vocabulary: str) -> ByteTokens | PieceTokens:
    """The tokenizer of a vocabulary file, kept by the worker process for its next tasks."""
    return (PieceTokens if vocabulary.endswith(".model") else ByteTokens)(vocabulary)


# --- merging ------------------------------------------------------------------


def diagonal_split(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many ends of ``a`` lie among the first ``d`` of the merge, for each diagonal.

    Equal ends come from ``a`` first. All binary searches take their steps together.
    """
    low = np.maximum(0, diagonals - len(b))
    high = np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # on a diagonal d, taking `middle` ends of a means taking d - middle of b
        other = diagonals - middle - 1
        more = np.zeros(len(low), bool)
        more[open_] = a[middle[open_]] <= b[other[open_]]
        low = np.where(open_ & more, middle + 1, low)
        high = np.where(open_ & ~more, middle, high)
    return low


def merge_pieces(a: np.ndarray, b: np.ndarray, size: int) -> Iterator[tuple[slice, slice]]:
    """Slices of both lists of ends, ``size`` ends of the merge in each piece.

    A border never parts two equal ends: the end of ``b`` goes with that of ``a``.
    """
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, size), total)
    in_a = diagonal_split(a, b, diagonals)
    in_b = diagonals - in_a
    parted = (in_a > 0) & (in_b < len(b))
    parted[parted] = a[in_a[parted] - 1] == b[in_b[parted]]
    in_b = in_b + parted
    for n in range(len(diagonals) - 1):
        yield slice(in_a[n], in_a[n + 1]), slice(in_b[n], in_b[n + 1])


def common_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ends that both lists of one piece hold."""
    if not len(a) or not len(b):
        return a[:0]
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return a[b[at] == a]


def group_numbers(
    a: np.ndarray, b: np.ndarray, piece: int = PIECE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of each token of A and of B, and the groups' ends.

    A piece numbers its groups from the number of common ends before it, so the
    tokens after its last common end and those up to the next piece's first one
    get one number.
    """
    of_a, of_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    ends, before = [], 0
    for in_a, in_b in merge_pieces(a, b, piece):
        common = common_ends(a[in_a], b[in_b])
        of_a[in_a] = before + np.searchsorted(common, a[in_a])
        of_b[in_b] = before + np.searchsorted(common, b[in_b])
        before += len(common)
        ends.append(common)
    return of_a, of_b, np.concatenate(ends) if ends else a[:0]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _merged_ids(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each group and how often each occurs."""
    both, times = np.unique(group * STRIDE + ids, return_counts=True)
    return both // STRIDE, both % STRIDE, times


def linked_pairs(
    of_a: np.ndarray, ids_a: np.ndarray, of_b: np.ndarray, ids_b: np.ndarray, groups: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(group, pair, times)`` of the linked ids, some groups at a time.

    A group of many tokens has its equal ids merged first, so a long run of
    one word costs its distinct ids, not its occurrences squared.
    """
    once_a, once_b = np.ones(len(ids_a), np.int64), np.ones(len(ids_b), np.int64)
    links = np.bincount(of_a, minlength=groups) * np.bincount(of_b, minlength=groups)
    large = links > LARGE_GROUP
    for chosen, merged in ((~large, False), (large, True)):
        sides = []
        for group, ids, times in ((of_a, ids_a, once_a), (of_b, ids_b, once_b)):
            inside = chosen[group]
            group, ids, times = group[inside], ids[inside], times[inside]
            sides.append(_merged_ids(group, ids) if merged else (group, ids, times))
        (group, ids, times), (other, other_ids, other_times) = sides
        width = np.bincount(other, minlength=groups)
        first = np.cumsum(width) - width
        reach = width[group]
        part = np.cumsum(reach) // EXPANSION
        borders = np.flatnonzero(np.diff(part)) + 1
        for rows in np.split(np.arange(len(group)), borders):
            if len(rows):
                left = np.repeat(rows, reach[rows])
                right = _spread(first[group[rows]], reach[rows])
                pair = ids[left].astype(np.int64) * STRIDE + other_ids[right]
                yield group[left], pair, times[left] * other_times[right]


# --- documents ----------------------------------------------------------------


class Side:
    """Tokens of some documents under one tokenizer, one after the other, as flat arrays."""

    def __init__(self, tokens, lists) -> None:
        self.counts = np.array([len(ids) for ids in lists], np.int64)
        total = int(self.counts.sum())
        if lists and isinstance(lists[0], np.ndarray):
            self.ids = np.concatenate(lists).astype(np.int64)
        else:
            self.ids = np.fromiter(itertools.chain.from_iterable(lists), np.int64, total)
        sizes, self.joined = _joined(self.ids, tokens)
        self.ends = np.cumsum(sizes)
        self.borders = np.concatenate([[0], np.cumsum(self.counts)])

    def bytes_of(self, n: int) -> bytes:
        low, high = (self.ends[at - 1] if at else 0 for at in self.borders[n : n + 2])
        return self.joined[low:high].tobytes()

    def keep(self, docs: np.ndarray) -> None:
        """Only these documents, by their places among all of them."""
        inside = np.repeat(np.isin(np.arange(len(self.counts)), docs), self.counts)
        sizes = np.diff(self.ends, prepend=0)[inside]
        self.ids, self.ends, self.counts = self.ids[inside], np.cumsum(sizes), self.counts[docs]


@functools.lru_cache(maxsize=4)
def _table(tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the whole vocabulary, and where each token's begin and how many they are."""
    sizes = np.array([len(piece) for piece in tokens.bytes], np.int64)
    return np.frombuffer(b"".join(tokens.bytes), np.uint8), np.cumsum(sizes) - sizes, sizes


def _joined(ids: np.ndarray, tokens) -> tuple[np.ndarray, np.ndarray]:
    data, starts, sizes = _table(tokens)
    return sizes[ids], data[_spread(starts[ids], sizes[ids])]


def _listing(
    of_a: np.ndarray, ids_a: np.ndarray, of_b: np.ndarray, ids_b: np.ndarray, groups: int
) -> np.ndarray:
    """All tokens in the order of the listing ``a,a|b;a|b,b`` and what follows each.

    Twice the id, plus one where the token is the last one of its side of a
    group; ids of B are set off by STRIDE.
    """
    size_a, size_b = (np.bincount(g, minlength=groups) for g in (of_a, of_b))
    before_a, before_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    out = np.empty(len(ids_a) + len(ids_b), np.int64)
    at_a = np.arange(len(ids_a))
    at_b = np.arange(len(ids_b))
    last_a = at_a == (before_a + size_a)[of_a] - 1
    last_b = at_b == (before_b + size_b)[of_b] - 1
    out[at_a + before_b[of_a]] = 2 * ids_a + last_a
    out[at_b + (before_a + size_a)[of_b]] = 2 * (ids_b + STRIDE) + last_b
    return out


@functools.lru_cache(maxsize=2)
def _written(size_a: int, size_b: int) -> dict[int, bytes]:
    """Each code of a listing as text."""
    table = {}
    for first, size, ends in ((0, size_a, (b",", b"|")), (STRIDE, size_b, (b",", b";"))):
        for n in range(size):
            for last in (0, 1):
                table[2 * (first + n) + last] = str(n).encode() + ends[last]
    return table


def align(texts: list[str | None], a, b, piece: int = PIECE) -> list[tuple]:
    """``(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)`` of each text."""
    found: list[tuple] = [(0, 0, 0, 0, "", [], [])] * len(texts)
    rows = [n for n, text in enumerate(texts) if text]
    given = [texts[n] for n in rows]
    one, other = (Side(tokens, tokens.encode(given) if given else []) for tokens in (a, b))
    raw = [(" " + text).encode("utf-8", "surrogatepass") for text in given]
    same = np.array(
        [n for n, data in enumerate(raw) if one.bytes_of(n) == data == other.bytes_of(n)], np.int64
    )
    if not len(same):
        return found
    rows = [rows[n] for n in same]
    one.keep(same)
    other.keep(same)
    of_a, of_b, ends = group_numbers(one.ends, other.ends, piece)
    groups = len(ends)
    # documents end at common ends, so each has whole groups
    doc_ends = one.ends[np.cumsum(one.counts) - 1]
    last = np.searchsorted(ends, doc_ends) + 1
    doc_of = np.repeat(np.arange(len(last)), np.diff(last, prepend=0))
    links = np.bincount(of_a, minlength=groups) * np.bincount(of_b, minlength=groups)
    n_links = np.add.reduceat(links, last - np.diff(last, prepend=0))
    parts = [
        _sums(doc_of[group], pair, times)
        for group, pair, times in linked_pairs(of_a, one.ids, of_b, other.ids, groups)
    ]
    doc, pair, times = _sums(*(np.concatenate(x) for x in zip(*parts)))
    borders = np.searchsorted(doc, np.arange(len(last) + 1))
    codes = _listing(of_a, one.ids, of_b, other.ids, groups)
    written = _written(len(a.bytes), len(b.bytes))
    tokens = np.concatenate([[0], np.cumsum(one.counts + other.counts)])
    for n, row in enumerate(rows):
        listing = b"".join(map(written.__getitem__, codes[tokens[n] : tokens[n + 1]].tolist()))
        mine = slice(borders[n], borders[n + 1])
        found[row] = (
            int(one.counts[n]),
            int(other.counts[n]),
            int(last[n] - (last[n - 1] if n else 0)),
            int(n_links[n]),
            hashlib.sha256(listing[:-1]).hexdigest(),
            pair[mine],
            times[mine],
        )
    return found


def _sums(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct ``(doc, pair)``, sorted, with the sum of their times."""
    order = np.lexsort((pair, doc))
    doc, pair, times = doc[order], pair[order], times[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(first)
    return doc[at], pair[at], np.add.reduceat(times, at) if len(at) else times


def _lots(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` characters, one row at least."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    borders = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return ((low, high) for low, high in zip(borders, borders[1:]) if high > low)


def aligned_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_a: str = VOCABULARY_A,
    vocabulary_b: str = VOCABULARY_B,
    piece: int = PIECE,
) -> DataFrame:
    """Written ``(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)``.

    ``row`` tells rows of one id apart; ``pairs`` are the distinct linked id
    pairs of the document, ``times`` how many links each has there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizer_of(vocabulary_a), tokenizer_of(vocabulary_b)
        row = TaskContext.get().partitionId() << 40
        names = [field.split()[0] for field in ALIGNED.split(", ")]
        for batch in batches:
            for low, high in _lots(batch.column(1), BATCH_CHARS):
                part = batch.slice(low, high - low)
                found = align(part.column(1).to_pylist(), a, b, piece)
                columns = [*zip(*found)]
                lists = [
                    pa.ListArray.from_arrays(
                        np.concatenate([[0], np.cumsum([len(x) for x in column])]).astype(np.int32),
                        np.concatenate([np.asarray(x, np.int64) for x in column]),
                    )
                    for column in columns[5:]
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(found))),
                        part.column(0),
                        *[pa.array(c, pa.int64()) for c in columns[:4]],
                        pa.array(columns[4], pa.string()),
                        *lists,
                    ],
                    names,
                )
                row += len(found)

    picked = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return materialize(picked.mapInArrow(run, ALIGNED), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Written ``(pair, n_docs, best)``: documents that hold the pair linked.

    ``best`` marks the pairs with the highest count of their A id.
    """
    counts = materialize(
        aligned.select(F.explode("pairs").alias("pair"))
        .groupBy("pair")
        .agg(F.count("*").alias("n_docs")),
        "pair-counts",
    )
    id_a = F.expr(f"pair DIV {STRIDE}").alias("id_a")
    highest = counts.groupBy(id_a).agg(F.max("n_docs").alias("highest"))
    counts = counts.select("*", id_a).join(highest, "id_a")
    best = F.col("n_docs") == F.col("highest")
    return materialize(counts.select("pair", "n_docs", best.alias("best")), "pair-facts")


def _common_from(counts: DataFrame, most: int) -> int:
    """The least power of two from which at most ``most`` pairs have so many documents."""
    power = F.floor(F.log2("n_docs")).cast("int").alias("power")
    left, found = most, 0
    for row in counts.groupBy(power).agg(F.count("*").alias("n")).orderBy(F.desc("power")).collect():
        left -= row.n
        if left < 0:
            found = 1 << (row.power + 1)
            break
    return found


def _linked(aligned: DataFrame) -> DataFrame:
    return aligned.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed(
        "pairs", "pair"
    )


def link_counts(
    aligned: DataFrame, counts: DataFrame, most_common: int = COMMON_PAIRS
) -> DataFrame:
    """``(row, n_best, count_sum)`` of the documents that have links."""
    least = _common_from(counts, most_common)
    common = F.broadcast(counts.filter(F.col("n_docs") >= least))
    links = _linked(aligned)
    # the others have fewer documents each than `least`
    others = links.join(common, "pair", "left_anti").join(
        counts.filter(F.col("n_docs") < least), "pair"
    )
    n_best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
    parts = [
        known.groupBy("row").agg(
            n_best.alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")
        )
        for known in (links.join(common, "pair"), others)
    ]
    both = parts[0].unionByName(parts[1])
    return both.groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )


def align_documents(docs: DataFrame, most_common: int = COMMON_PAIRS, **options) -> DataFrame:
    """Alignment of two tokenizers' tokens on every row of ``docs``.

    ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256,
    pairs, times)``. Links are all occurrence pairs of one group. Null and empty
    texts, and texts that a tokenizer does not give back byte for byte, have no
    tokens. Rows that share an id, or have none, stay rows of their own and count
    as documents of their own. An empty table gives an empty result; other
    columns are not read.
    """
    aligned = aligned_documents(docs, **options)
    counts = link_counts(aligned, pair_counts(aligned), most_common)
    zero = F.lit(0).cast("bigint")
    return aligned.join(counts, "row", "left").select(
        *("doc_id", "n_a", "n_b", "n_groups", "n_links"),
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        *("groups_sha256", "pairs", "times"),
    )


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under both vocabularies, aligned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_documents(docs).drop("pairs", "times")
