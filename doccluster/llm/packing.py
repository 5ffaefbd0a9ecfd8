"""Best-fit packing of tokenised documents, certified by lower bounds.

Documents become token ids, are cut into pieces of at most ``capacity`` tokens,
and the pieces are packed: groups of bounded size are packed by best-fit
decreasing, and a lower bound from dual feasible functions certifies a group's
number of sequences. Groups with a gap between the two exchange the pieces of
their emptiest sequences and pack those again, fewer groups each round. A
certified group keeps its sequences, but for the emptiest one, which holds
what rounding up to whole sequences left free. The exchange ends when the
bound over all pieces is reached or one group is left.
"""

from __future__ import annotations

import functools
import itertools
import logging
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doccluster.sources.scratch import materialize

log = logging.getLogger(__name__)

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = 0
# Pieces that one group packs in the first round, on average.
GROUP_ROWS = 50_000
# Groups that meet in a later round; together they hand over the pieces of one group.
EXCHANGE = 8
# Bits for the sequences of one group in a sequence's number.
BIN_BITS = 24
# Characters of the texts that are words at the same time.
SLICE_CHARS = 8_000_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


def load_tokenizer(vocabulary: str):
    """The tokenizer of a path, or of a file of the public collection."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(
        vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    )


class WordIds:
    """Token ids of words, each distinct word encoded once.

    A word of letters only is one word of the tokenizer's own, ended by one
    token with the end-of-word mark, so many of them are encoded as one text.
    A full stop or comma after a letter is a token of its own.
    """

    JOINED = 512
    MOST = 400_000

    def __init__(self, tokenizer, most: int = MOST) -> None:
        self.tokenizer, self.most = tokenizer, most
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.tails = {c: self._encode([c])[0] for c in ".,"}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(0, np.uint32), [], []

    def _encode(self, texts: list[str]) -> list[list[int]]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [e.ids for e in encoded]

    def _learn(self, stems: list[str], letters: np.ndarray) -> np.ndarray:
        """Each new stem's number; ``letters`` says which are ASCII letters only."""
        one_word = np.fromiter((a or _one_word(w) for w, a in zip(stems, letters)), bool, len(stems))
        order = np.argsort(~one_word, kind="stable")
        words = [stems[n] for n in order]
        joint = int(one_word.sum())
        parts = [
            " ".join(words[n : min(n + self.JOINED, joint)]) for n in range(0, joint, self.JOINED)
        ]
        flat = _joined(self._encode(parts))
        last = np.flatnonzero(self.ends[flat]) + 1
        if len(last) != joint:  # not a vocabulary with one end per word
            joint, flat, last = 0, flat[:0], last[:0]
        lists = self._encode(words[joint:])
        sizes = np.concatenate([np.diff(last, prepend=0), np.array([*map(len, lists)], np.int64)])
        starts = np.cumsum(sizes) - sizes + len(self.flat)
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        self.flat = np.concatenate([self.flat, flat, _joined(lists)])
        self.start = np.concatenate([self.start, starts]).astype(np.int64)
        self.size = np.concatenate([self.size, sizes]).astype(np.int64)
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(first, first + len(words))
        return number

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct ``words`` one after the other, and each word's number of ids."""
        if len(self.known) > self.most:
            self._forget()
        stems, tails = _stems(words)
        coded = stems.dictionary_encode()
        letters = pc.ascii_is_alpha(coded.dictionary).to_numpy(zero_copy_only=False)
        names = coded.dictionary.to_pylist()
        place = np.fromiter(map(self.known.get, names, itertools.repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(place < 0)
        place[new] = self._learn([names[n] for n in new], letters[new])
        at = place[coded.indices.to_numpy(zero_copy_only=False)]
        extra = np.zeros(len(at), np.int64)
        for mark, ids in self.tails.items():
            extra[tails[mark]] = len(ids)
        sizes = self.size[at] + extra
        ends = np.cumsum(sizes)
        out = np.empty(int(sizes.sum()), np.uint32)
        own = np.ones(len(out), bool)
        for mark, ids in self.tails.items():
            where = ends[tails[mark]]
            for n, token in enumerate(reversed(ids), 1):
                out[where - n], own[where - n] = token, False
        out[own] = self.flat[_spread(self.start[at], self.size[at])]
        return out, sizes


@functools.lru_cache(maxsize=2)
def word_ids_of(vocabulary: str, most: int) -> WordIds:
    """The words of a vocabulary, kept by the worker process for its next tasks.

    It forgets them when it knows more than ``most``.
    """
    return WordIds(load_tokenizer(vocabulary), most)


def _stems(words: pa.Array) -> tuple[pa.Array, dict[str, np.ndarray]]:
    """Words without a full stop or comma that ends them after an ASCII letter, and
    which words had either; words of ASCII letters only are in lower case."""
    tailed = {c: pc.match_substring_regex(words, f"[A-Za-z][{c}]$") for c in ".,"}
    either = functools.reduce(pc.or_, tailed.values())
    stems = pc.if_else(either, pc.utf8_slice_codeunits(words, 0, -1), words)
    stems = pc.if_else(pc.ascii_is_alpha(stems), pc.ascii_lower(stems), stems)
    return stems, {c: t.to_numpy(zero_copy_only=False) for c, t in tailed.items()}


def _joined(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(lists), np.uint32)


def _one_word(word: str) -> bool:
    return word.isalpha() and (
        word.isascii() or (word.lower().isalpha() and unicodedata.is_normalized("NFC", word))
    )


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after the other."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


def encode_texts(texts: pa.Array, words_ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and each text's number of ids.

    The tokenizer breaks its input at white space, so each distinct word
    between blanks is encoded once and its ids are put together again.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    flat, sizes = words_ids.encode(coded.dictionary)
    starts = np.cumsum(sizes) - sizes
    at = coded.indices.to_numpy(zero_copy_only=False)
    ids = flat[_spread(starts[at], sizes[at])]
    ends = np.concatenate([[0], np.cumsum(sizes[at])])
    borders = ends[np.concatenate([[0], np.cumsum(per_text)])]
    return ids, np.diff(borders)


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` characters each, one row at least."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    borders = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for low, high in zip(borders, borders[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def tokenize_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    capacity: int = CAPACITY,
    end: int = END,
    slice_chars: int = SLICE_CHARS,
    most_words: int = WordIds.MOST,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``, ids as little-endian 32-bit words.

    A document is its ids followed by the id ``end``; a null or empty text is
    that one id. Only documents longer than ``capacity`` are cut, into pieces
    of that length; the last may be shorter. Repeated rows and null ids stay.
    A worker holds the words of ``slice_chars`` characters at a time and
    remembers ``most_words`` words: less memory, more work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words_ids = word_ids_of(vocabulary, most_words)
        for batch in batches:
            for part in _slices(batch, slice_chars):
                yield _pieces(part, words_ids, capacity, end)
        # the worker stays for other tasks and stages, its buffers need not
        pa.default_memory_pool().release_unused()

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, PIECES)


def _pieces(batch: pa.RecordBatch, words_ids: WordIds, capacity: int, end: int) -> pa.RecordBatch:
    ids, counts = encode_texts(batch.column(1), words_ids)
    counts = counts + 1
    ends = np.cumsum(counts)
    whole = np.empty(int(counts.sum()), "<u4")
    closing = np.zeros(len(whole), bool)
    closing[ends - 1] = True
    whole[closing], whole[~closing] = end, ids
    pieces = -(-counts // capacity)
    row = np.repeat(np.arange(len(counts)), pieces)
    number = _spread(np.zeros(len(counts), np.int64), pieces)
    start = number * capacity
    length = np.minimum(capacity, counts[row] - start)
    offsets = np.concatenate([[0], np.cumsum(length)]) * 4
    data = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(whole)]
    )
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array(row)),
            pa.array(number, pa.int32()),
            pa.array(start, pa.int64()),
            pa.array(length, pa.int64()),
            data.cast(pa.binary()),
        ],
        ["doc_id", "piece", "start", "length", "ids"],
    )


# --- packing ----------------------------------------------------------------


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; sequences are numbered from 0.

    Longest first, each into the fullest sequence that has room for it. Open
    sequences lie in one list per free length; a bit set finds the least
    free length that suffices.
    """
    order = np.argsort(-lengths, kind="stable")
    where = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled, count = 0, 0
    for n, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = filled >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = free[room].pop()
            if not free[room]:
                filled &= ~(1 << room)
        else:
            room, number = capacity, count
            count += 1
        where[n], offset[n] = number, capacity - room
        free[room - size].append(number)
        filled |= 1 << (room - size)
    return where, offset


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest sequences that any packing needs, see :func:`bound_of_counts`."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """The bound for ``counts[n]`` pieces of each length ``n``, by dual feasible functions.

    Two families: lengths below a threshold count nothing and those above
    ``capacity`` less the threshold count whole; and lengths rounded to k-ths
    of the capacity. Both hold for every threshold and k.
    """
    sizes = np.arange(capacity + 1)
    number = np.asarray(counts, np.int64)
    total, seen = np.cumsum(number * sizes), np.cumsum(number)
    best = -(-int(total[-1]) // capacity)
    for low in range(1, capacity // 2 + 1):
        whole = int(seen[-1] - seen[capacity - low])
        middle = int(total[capacity - low] - total[low - 1])
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 21):
        exact = (sizes * (k + 1)) % capacity == 0
        # k times the function's value, which is a whole number or a share of capacity
        weight = np.where(exact, sizes * k, capacity * ((sizes * (k + 1)) // capacity))
        best = max(best, -(-int((weight.astype(object) * number).sum()) // (k * capacity)))
    return best


def _handed_over(
    where: np.ndarray, used: np.ndarray, capacity: int, certified: bool, most_pieces: int
) -> np.ndarray:
    """Which sequences a group hands over: emptiest first, full ones never.

    A certified group hands over one. A group with a gap hands over as many as
    hold ``most_pieces`` pieces together, one at least; what it keeps is the
    fuller part.
    """
    emptiest = np.argsort(used, kind="stable")
    held = np.cumsum(np.bincount(where, minlength=len(used))[emptiest])
    count = 1 if certified else max(1, int(np.searchsorted(held, most_pieces, side="right")))
    on = np.zeros(len(used), bool)
    chosen = emptiest[:count]
    on[chosen[used[chosen] < capacity]] = True
    return on


def _repack(pdf: pd.DataFrame, capacity: int, most_pieces: int) -> pd.DataFrame:
    """Pack one group anew and mark the pieces that go on to the next round.

    The old packing is kept where the new one is no better. A group without a
    gap between its sequences and its bound is certified.
    """
    lengths = pdf["length"].to_numpy(np.int64)
    where, offset = best_fit_decreasing(lengths, capacity)
    number = int(where.max()) + 1
    held = pdf["sequence"].nunique()
    if pdf["sequence"].notna().all() and held <= number:
        where = pd.factorize(pdf["sequence"])[0]
        offset = pdf["offset"].to_numpy(np.int64)
        number = held
    used = np.bincount(where, weights=lengths, minlength=number).astype(np.int64)
    certified = number == lower_bound(lengths, capacity)
    on = _handed_over(where, used, capacity, certified, most_pieces)
    group = int(pdf["group"].iloc[0])
    return pd.DataFrame(
        {
            "uid": pdf["uid"],
            "length": lengths,
            "group": group,
            "sequence": (np.int64(pdf["round"].iloc[0]) << 56) | (np.int64(group) << BIN_BITS) | where,
            "offset": offset,
            "goes_on": on[where],
            "certified": certified,
        }
    )


PACKED = (
    "uid bigint, length bigint, group bigint, sequence bigint, offset bigint,"
    " goes_on boolean, certified boolean"
)


def least_sequences(pieces: DataFrame, capacity: int = CAPACITY) -> int:
    """The bound over all pieces of a table with ``length``."""
    # one row per length, at most ``capacity`` of them
    rows = pieces.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, np.int64)
    for row in rows:
        counts[row.length] = row["count"]
    return bound_of_counts(counts, capacity)


def pack_lengths(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
    exchange: int = EXCHANGE,
) -> DataFrame:
    """``(uid, sequence_id, offset)`` for a written table ``(uid, length)``.

    ``uid`` is unique, lengths lie between 1 and ``capacity``. Pieces of full
    length are sequences by themselves. A group has about ``group_rows`` pieces
    in the first round; later it has as many at most, or one sequence of each
    of ``exchange`` groups. Each round is written.
    """
    full = pieces.filter(F.col("length") == capacity).select(
        "uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    short = pieces.filter(F.col("length") < capacity).select("uid", "length")
    bound = least_sequences(short, capacity)
    groups = max(1, -(-short.count() // group_rows))
    none = F.lit(None).cast("bigint")
    state = short.select(
        "uid",
        "length",
        F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("group"),
        none.alias("sequence"),
        none.alias("offset"),
    )
    done, turn, settled = [full], 0, 0
    most_pieces = group_rows // exchange

    def repack(pdf: pd.DataFrame) -> pd.DataFrame:
        return _repack(pdf, capacity, most_pieces)

    while True:
        packed = materialize(
            state.withColumn("round", F.lit(turn)).groupBy("group").applyInPandas(repack, PACKED),
            "packed",
        )
        # each sequence has one piece at offset 0
        counts = packed.filter("offset = 0").agg(
            F.count_if("goes_on").alias("going"),
            F.count_if(~F.col("goes_on")).alias("staying"),
            F.count_if(~F.col("certified")).alias("uncertified"),
        )
        count = counts.first()
        number = settled + count.going + count.staying
        log.info(
            "round %d: %d groups, %d sequences against a bound of %d, %d in groups with a gap",
            turn, groups, number, bound, count.uncertified,
        )
        last = groups == 1 or not count.going or number == bound
        final = packed if last else packed.filter("NOT goes_on")
        done.append(final.select("uid", F.col("sequence").alias("sequence_id"), "offset"))
        if last:
            return functools.reduce(DataFrame.unionByName, done)
        settled += count.staying
        groups, turn = -(-groups // exchange), turn + 1
        state = packed.filter("goes_on").select(
            "uid",
            "length",
            F.pmod("group", F.lit(groups)).cast("bigint").alias("group"),
            "sequence",
            "offset",
        )


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, each row with a unique ``uid``."""
    return materialize(df.withColumn("uid", F.monotonically_increasing_id()), name)


def pack_documents(
    docs: DataFrame,
    digest: dict[str, Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    capacity: int = CAPACITY,
    **memory: int,
) -> DataFrame:
    """``(doc_id, piece, start, length, ..., sequence_id, offset)`` of every piece.

    ``digest`` names columns to derive from a piece's ``ids`` while they are at
    hand; by default the ids themselves are returned, as ``ids``. An empty
    table gives an empty result.
    """
    digest = {"ids": F.col("ids")} if digest is None else digest
    pieces = tokenize_pieces(docs, id_col, text_col, vocabulary, capacity, **memory)
    pieces = numbered(
        pieces.select("doc_id", "piece", "start", "length", *[c.alias(n) for n, c in digest.items()]),
        "pieces",
    )
    return pieces.join(pack_lengths(pieces, capacity), "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the training sequences of ``pack_documents``.

    A sequence's pieces are few and together at most ``capacity`` tokens.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(
        F.transform(parts, lambda p: F.hex(p["ids"])), F.lit(""), lambda a, b: F.concat(a, b)
    )
    return packed.groupBy("sequence_id").agg(F.unhex(joined).alias("ids"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the CRC-32 of their ids, packed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed_digest(docs)


def packed_digest(docs: DataFrame, **memory: int) -> DataFrame:
    """Pieces with the CRC-32 of their ids; ``memory`` as for :func:`tokenize_pieces`."""
    packed = pack_documents(docs, {"ids_crc32": F.crc32("ids")}, **memory)
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
