"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (hashed)
and of the word itself, a document's vector the mean of its words' vectors, and
a softmax over two classes reads it. Vectors and softmax are trained together,
in numpy on the driver, on a bounded sample of the labelled rows. A word never
seen in training is still placed by the n-grams it shares with known words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 17
NGRAMS = (3, 4, 5)
DIMENSIONS = 4
EPOCHS = 60
# Adam's step, and pairs of weight decay and the floor of its denominator to
# choose from: buckets with little evidence have gradients below the floor and
# move less than a step, so that rare ones shrink and none is cut off.
RATE = 1.0
SETTINGS = ((0.002, 1e-4), (0.002, 1e-6))
PARTS = 3
SEED = 7
# The training sample: at most this many rows of each class, none longer than
# this many characters, the ones with the smallest hashes of their ids.
SAMPLE_ROWS = 2_500
SAMPLE_CHARS = 4_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
PRIME = 0x01000193
MIX = 0x9E3779B1
# Characters per step of work in a task.
STEP_CHARS = 1_000_000


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased words, white space removed, and each text's number of words."""
    lower = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    listed = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(lower))
    counts = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
    return listed.flatten(), counts


def ngram_buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(word, bucket)`` of every n-gram of every word and of the whole words."""
    words = words.cast(pa.large_binary())
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words.to_pylist()), np.uint8)
    sizes = sizes + 2
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    # bytes from here to the word's end
    left = (np.repeat(ends, sizes) - np.arange(len(data))).astype(np.int32)
    found_words, found_buckets = [], []
    value = np.zeros(len(data), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        # byte n - 1 after each start joins the n-grams that begin there
        reach = len(data) - n + 1
        if reach <= 0:
            break
        value = value[:reach] * np.uint32(PRIME) ^ data[n - 1 :]
        if n in NGRAMS:
            inside = np.flatnonzero(left[:reach] >= n)
            found_words.append(owner[inside])
            found_buckets.append(_bucket(value[inside] + np.uint32(n)))
    # a whole word by the sum of its bytes' products with powers of the prime
    place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, PRIME, np.uint32), dtype=np.uint32)
    whole = np.add.reduceat(data * powers[place], ends - sizes) if len(sizes) else value[:0]
    found_words.append(np.arange(len(sizes), dtype=np.int32))
    found_buckets.append(_bucket(whole.astype(np.uint32)))
    return np.concatenate(found_words), np.concatenate(found_buckets)


def _bucket(value: np.ndarray) -> np.ndarray:
    mixed = (value ^ (value >> np.uint32(15))) * np.uint32(MIX)
    return (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)


@dataclass
class Model:
    """``weight`` per bucket: its vector read by the softmax, toxic less other."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of class 1 per text; without words that of the bias."""
        words, counts = split_words(texts)
        coded = words.dictionary_encode()
        word, bucket = ngram_buckets(coded.dictionary)
        number = len(coded.dictionary)
        of_word = np.bincount(word, self.weight[bucket], number) / np.bincount(word, minlength=number)
        at = coded.indices.to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(len(counts)), counts)
        total = np.bincount(text, of_word[at] if len(at) else None, len(counts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(counts, 1) + self.bias, -30, 30)))


def _mean_matrix(row: np.ndarray, column: np.ndarray, share: np.ndarray, rows: int, columns: int):
    """Products of a sparse matrix, and of its transpose, with dense columns."""

    def forward(x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(row, share * c[column], rows) for c in x.T], axis=1)

    def backward(x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(column, share * c[row], columns) for c in x.T], axis=1)

    return forward, backward


def train(texts: list[str], toxic: list[int], prior: float) -> Model:
    """Fit under those of SETTINGS that do best on parts of the rows left out in turn.

    ``prior`` is the share of class 1 among all labelled rows. With too few rows
    of a class for that, the first settings hold.
    """
    labels = np.asarray(toxic, int)
    if min(labels.sum(), (1 - labels).sum()) < PARTS:
        return _fitted(texts, toxic, prior, *SETTINGS[0])
    # the rows of each class are dealt in turn, copies of a text to one part
    part = np.zeros(len(labels), int)
    place: dict[str, int] = {}
    for value in (0, 1):
        for row in np.flatnonzero(labels == value):
            part[row] = place.setdefault(texts[row], len(place)) % PARTS
    # in the shares that the classes have among all labelled rows
    weight = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
    right, named = np.zeros(len(SETTINGS)), np.zeros(len(SETTINGS))
    for left in range(PARTS):
        learn, test = np.flatnonzero(part != left), np.flatnonzero(part == left)
        shown = pa.array([texts[n] for n in test], pa.string())
        for n, setting in enumerate(SETTINGS):
            model = _fitted([texts[i] for i in learn], labels[learn].tolist(), prior, *setting)
            caught = model.scores(shown) >= THRESHOLD
            right[n] += weight[test][caught & (labels[test] == 1)].sum()
            named[n] += weight[test][caught].sum()
    # F1 of the threshold: the rows that are toxic are the same for all settings
    f1 = right / (named + weight[labels == 1].sum())
    return _fitted(texts, toxic, prior, *SETTINGS[int(np.argmax(f1))])


def _fitted(texts: list[str], toxic: list[int], prior: float, decay: float, floor: float) -> Model:
    """Fit embeddings and softmax by full-batch Adam on cross-entropy.

    The bias is moved from the sample's share of class 1 to ``prior``.
    """
    share = float(np.mean(toxic)) if toxic else 0.0
    if not 0 < share < 1 or not 0 < prior < 1:
        # one class only: nothing to tell apart
        known = min(max(prior, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS), float(np.log(known / (1 - known))))
    words, counts = split_words(pa.array(texts, pa.string()))
    coded = words.dictionary_encode()
    word, bucket = ngram_buckets(coded.dictionary)
    number = len(coded.dictionary)
    text = np.repeat(np.arange(len(counts)), counts) * number
    pair, many = np.unique(text + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    text, used = (pair // number).astype(np.int32), (pair % number).astype(np.int32)
    del words, coded, pair
    over, over_back = _mean_matrix(text, used, many / counts[text], len(counts), number)
    slots, slot = np.unique(bucket, return_inverse=True)
    share_of_gram = 1 / np.bincount(word, minlength=number)[word]
    up, up_back = _mean_matrix(word, slot.astype(np.int32), share_of_gram, number, len(slots))
    del word, bucket, slot, share_of_gram

    rng = np.random.default_rng(SEED)
    embedding = rng.normal(0, 0.1, (len(slots), DIMENSIONS))
    softmax = rng.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.zeros(2)
    parameters = [embedding, softmax, bias]
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    target = np.eye(2)[np.asarray(toxic)]
    for epoch in range(1, EPOCHS + 1):
        document = over(up(embedding))
        raw = document @ softmax + bias
        odds = np.exp(raw - raw.max(axis=1, keepdims=True))
        error = (odds / odds.sum(axis=1, keepdims=True) - target) / len(target)
        gradients = [up_back(over_back(error @ softmax.T)), document.T @ error, error.sum(axis=0)]
        for p, g, m, v in zip(parameters, gradients, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p *= 1 - RATE * decay
            p -= RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + floor)
    moved = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    weight = np.zeros(BUCKETS)
    weight[slots] = embedding @ (softmax[:, 1] - softmax[:, 0])
    return Model(weight, float(bias[1] - bias[0] + moved))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id is one of them."""
    remainder = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(remainder == HELD_OUT, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> Model:
    """Train on the labelled rows outside the held-out fold.

    Rows with a null label, id or text are left out, and of rows that repeat an
    id and a label one is taken.
    """
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .distinct()
    )
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    picked = docs.select("doc_id", F.col(text_col).alias("text")).filter(
        F.length("text").between(1, SAMPLE_CHARS)
    )
    order = F.xxhash64("doc_id")
    texts, toxic = [], []
    for value in (0, 1):
        # twice the rows, as some of their texts may be missing or too long
        ids = known.filter(F.col("toxic") == value).select("doc_id").orderBy(order, "doc_id")
        ids = ids.limit(2 * SAMPLE_ROWS)
        rows = picked.join(F.broadcast(ids), "doc_id").orderBy(order, "doc_id", "text")
        for row in rows.limit(SAMPLE_ROWS).collect():
            texts.append(row.text)
            toxic.append(value)
    return train(texts, toxic, prior)


def scored(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score between 0 and 1 of each whole text, in steps of bounded size.

    A null text or one without words gets the score of the bias alone, the
    prior share of toxic rows about.
    """
    shared = spark.sparkContext.broadcast((model.weight, model.bias))

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        fitted = Model(*shared.value)
        sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // STEP_CHARS
        borders = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        values = [fitted.scores(texts.slice(a, b - a)) for a, b in zip(borders, borders[1:])]
        # the worker stays for other tasks and stages, its buffers need not
        pa.default_memory_pool().release_unused()
        return pa.array(np.concatenate(values))

    return run(text)


def score(
    docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """The columns ``keep`` of every row and its ``score``; all rows stay."""
    return docs.select(*keep, scored(docs.sparkSession, model, F.col(text_col)).alias("score"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score at the threshold or above.

    Null and empty texts stay: their score is the share of toxic labels alone.
    """
    none = F.coalesce(F.length(text_col), F.lit(0)) == 0
    return docs.filter(none | (scored(docs.sparkSession, model, F.col(text_col)) < THRESHOLD))
