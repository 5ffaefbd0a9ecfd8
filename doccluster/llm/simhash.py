"""SimHash near-duplicate groups, linked through BK-trees over fingerprints.

Two 64-bit fingerprints that differ in at most two bits agree in at least two
of their four 16-bit blocks. Every distinct fingerprint is therefore sent to
the six shards its pairs of blocks name. A shard's BK-tree keys each child by
its integer Hamming distance to its parent, and a search from distance ``d``
follows only edges ``d - radius`` to ``d + radius``. A tree goes to the one
task that holds all fingerprints which can match in it, in place of a broadcast
to all tasks, because the trees grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doccluster.llm.components import components
from doccluster.llm.columns import unused
from doccluster.sources.scratch import materialize

SEED = 42
WORDS = 3
RADIUS = 2
BLOCKS = 4
# A shard above this many fingerprints is divided once more by the other bits,
# after which it can hold no more than that: 16 bits are left to differ.
SHARD_ROWS = 1 << 16
# Fingerprints per round of work in a task, and tree visits per block of queries.
CHUNK_ROWS = 200_000
BLOCK_VISITS = 4_000_000
SHINGLES = 1 << 16
EDGE_KEYS = 65


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit SimHash of the three-word shingles of a text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends[WORDS - 1 :].tolist() or [len(joined)]
    counts, total = np.zeros(64, np.int64), len(ends)
    for low in range(0, total, SHINGLES):
        values = np.fromiter(
            (
                hashed(joined[s:e], SEED)
                for s, e in zip(starts[low : low + SHINGLES], ends[low : low + SHINGLES])
            ),
            np.uint64,
        )
        bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, and its ``fp``; a null text counts as empty."""
    picked = docs.select(F.col(text_col).cast("binary").alias("_text"), *keep)
    schema = picked.drop("_text").withColumn("fp", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([fingerprint(t) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], values], [*batch.schema.names[1:], "fp"]
            )

    return picked.mapInArrow(run, schema)


# --- BK-trees ---------------------------------------------------------------


class Forest:
    """One BK-tree per shard over sorted shard keys, as flat arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.values = values
        self.first, self.size = np.unique(keys, return_index=True, return_counts=True)[1:]
        self.root = np.repeat(self.first, self.size)
        code = np.full(len(values), -1, np.int64)
        rest = np.flatnonzero(self.root != np.arange(len(values)))
        at = self.root[rest]
        while len(rest):
            edge = at * EDGE_KEYS + np.bitwise_count(values[rest] ^ values[at])
            _, picked, where = np.unique(edge, return_index=True, return_inverse=True)
            code[rest[picked]] = edge[picked]
            at = rest[picked][where]
            left = at != rest
            rest, at = rest[left], at[left]
        self.child = np.argsort(code, kind="stable")
        self.code = code[self.child]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, other), query the larger index, within ``radius``."""
        found, asked, node = [], queries, self.root[queries]
        while len(asked):
            gap = np.bitwise_count(self.values[asked] ^ self.values[node]).astype(np.int64)
            near = (gap <= radius) & (node < asked)
            found.append((asked[near], node[near]))
            base = node * EDGE_KEYS
            low = np.searchsorted(self.code, base + np.maximum(gap - radius, 0), "left")
            high = np.searchsorted(self.code, base + np.minimum(gap + radius, 64), "right")
            many = high - low
            before = np.cumsum(many) - many
            place = np.repeat(low - before, many) + np.arange(int(many.sum()))
            asked, node = np.repeat(asked, many), self.child[place]
        return tuple(np.concatenate(x) for x in zip(*found))

    def linked(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """A forest that connects what links within ``radius`` connect."""
        asking = np.flatnonzero(np.repeat(self.size, self.size) > 1)
        work = np.cumsum(np.repeat(self.size, self.size)[asking])
        part = work // BLOCK_VISITS
        label = np.arange(len(self.values))
        for block in np.split(asking, np.flatnonzero(np.diff(part)) + 1):
            if len(block):
                _join(label, *self.search(block, radius))
        member = np.flatnonzero(label != np.arange(len(label)))
        return member, label[member]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of each pair; a label is the class's smallest index."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


# --- shards -----------------------------------------------------------------


def _field(value: Column, bit: int, width: int) -> Column:
    return F.shiftrightunsigned(value, bit).bitwiseAND((1 << width) - 1)


def _pair_key(value: Column, bits: list[int], width: int, pair: tuple[int, int]) -> Column:
    return F.shiftleft(_field(value, bits[pair[0]], width), width).bitwiseOR(
        _field(value, bits[pair[1]], width)
    )


def sharded(values: DataFrame) -> DataFrame:
    """``(key, fp)``: every fingerprint in each of the shards it belongs to."""
    fp, width = F.col("fp"), 64 // BLOCKS
    bits = [n * width for n in range(BLOCKS)]
    pairs = list(combinations(range(BLOCKS), 2))
    keys = [
        F.shiftleft(F.lit(n * 8).cast("bigint"), 48).bitwiseOR(_pair_key(fp, bits, width, pair))
        for n, pair in enumerate(pairs)
    ]
    coarse = materialize(values.select("fp", F.explode(F.array(*keys)).alias("key")), "shards")
    large = materialize(
        coarse.groupBy("key").count().filter(F.col("count") > SHARD_ROWS).select("key"), "large"
    )
    fine = coarse.join(large, "key", "left_semi").select("fp", "key", *_finer_keys(pairs, bits, width))
    return coarse.join(large, "key", "left_anti").select("key", "fp").unionByName(
        fine.select(F.explode("finer").alias("key"), "fp")
    )


def _finer_keys(pairs, bits: list[int], width: int) -> list[Column]:
    """Six keys of the 32 bits in common and two of the four other bytes."""
    fp, key, options = F.col("fp"), F.col("key"), None
    for n, pair in enumerate(pairs):
        others = [b for i, b in enumerate(bits) if i not in pair]
        bytes_left = [b + h for b in others for h in (0, width // 2)]
        finer = F.array(
            *[
                F.shiftleft(F.lit(n * 8 + 1 + m).cast("bigint"), 48)
                .bitwiseOR(F.shiftleft(key.bitwiseAND((1 << 32) - 1), 16))
                .bitwiseOR(_pair_key(fp, bytes_left, width // 2, inner))
                for m, inner in enumerate(combinations(range(4), 2))
            ]
        )
        here = F.shiftright(key, 48) == n * 8
        options = F.when(here, finer) if options is None else options.when(here, finer)
    return [options.alias("finer")]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole shards from batches in order of the key."""
    keys, values = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        values = np.concatenate([values, batch.column(1).to_numpy()])
        if len(keys) >= CHUNK_ROWS:
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield keys[:cut], values[:cut]
                keys, values = keys[cut:], values[cut:]
    if len(keys):
        yield keys, values


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: edges that connect all distinct fingerprints within ``radius``."""
    if radius > RADIUS:
        raise ValueError(f"shards find all links up to {RADIUS} bits only")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, found in _chunks(batches):
            a, b = Forest(keys, found.view(np.uint64)).linked(radius)
            yield pa.RecordBatch.from_arrays([pa.array(found[a]), pa.array(found[b])], ["a", "b"])

    shards = sharded(values).select("key", "fp").repartition("key").sortWithinPartitions("key")
    return shards.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """``keep``, ``fp``, ``root`` and ``component_id`` for every row of ``docs``.

    ``keep`` holds ``doc_id``. Rows whose fingerprints link, directly or through
    others, share the smallest fingerprint among them, ``root``, and the smallest
    ``doc_id``; that is null only where all of theirs are null. Texts without words have the fingerprint zero and link like
    any other. Repeated rows stay. Other columns are not read.
    """
    printed = materialize(fingerprints(docs, keep, text_col), "fingerprints")
    values = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "values")
    roots = components(links(values.select("fp")))
    placed = materialize(
        values.join(roots, values["fp"] == roots["node"], "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), "smallest"
        ),
        "placed",
    )
    smallest = materialize(
        placed.groupBy("root").agg(F.min("smallest").alias("component_id")), "smallest"
    )
    named = materialize(placed.join(smallest, "root").select("fp", "root", "component_id"), "components")
    return printed.join(named, "fp").select(*keep, "fp", "root", "component_id")


def keep_one(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the one of the smallest id.

    Among rows of equal ids one stays, null ids count as largest. All columns
    are kept, whatever their names.
    """
    uid = unused(docs, "_uid")
    numbered = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(
        numbered.select(F.col(uid).alias("_uid"), "doc_id", F.col(text_col).alias("_text")),
        ("_uid", "doc_id"),
        "_text",
    )
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_uid")
    first = materialize(
        found.groupBy("root").agg(F.min(order)["_uid"].alias("_uid")).select("_uid"),
        "first",
    )
    # the rows to drop are the shorter list, so the texts move only where even that is long
    dropped = found.select("_uid").join(first, "_uid", "left_anti")
    dropped = materialize(dropped.withColumnRenamed("_uid", uid), "dropped")
    return numbered.join(dropped, uid, "left_anti").select(*docs.columns)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
