"""Operator 12: quality by random-indexing word vectors and a small neural network.

Words are runs of letters or digits, and runs of other signs, case kept. Each word has a
row of BUCKETS and an index vector (NONZERO entries +-1 among DIM) by a hash. A row's
context vector is the sum of the index vectors of what stands within WINDOW words of its
words, over all texts of the corpus; scaled to length 1 it is the words' vector. A document is
the mean and spread of its words' vectors, and how alike neighbouring words are and are
to the document. On that, a network of two layers, written in numpy, is trained on a
bounded sample of labelled rows (TRAIN_ROWS, those with the smallest hashes), stops
where a part of it kept apart (FOLDS) is predicted best, and is calibrated by a temperature
fitted on that part.

The context vectors cover the whole corpus: tasks add up integers, at most BUCKETS rows a
task cross the shuffle. The driver and the tasks hold BUCKETS x DIM numbers, whatever the
corpus. Labels are learned only from rows that the caller admits; text is all that a score
depends on.

Null or empty text has a vector of zeros and gets the score of such texts; repeated rows
and equal texts get equal scores. Very long texts are read piece by piece within one task. Labels of unknown
documents are ignored, of several labels of a document the highest holds; where the labels
hold one class only, every score is that class's share (0 without labels). An empty table
gives an empty result. Columns other than doc_id and text aren't looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_words import Words, pieces, split_words
from .common import documents, long_id, small_batches, written

BUCKETS, DIM, NONZERO, WINDOW = 1 << 15, 64, 4, 2
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, FOLDS, SEED = 32, 60, 128, 0.005, 1e-4, 4, 12
#: Vectors of length 1 travel as integers of this unit.
UNIT = 1 << 14
#: Words of a text that are summed at a time.
POOLED_WORDS = 4096
#: Runs of signs stand apart from the words beside them.
SIGNS = r"([^\p{L}\p{N}\s]+)"


def sign_words(texts: pa.Array) -> Words:
    return split_words(texts, lambda t: pc.split_pattern_regex(pc.replace_substring_regex(t, SIGNS, r" \1 "), r"\s+"))


def buckets_of(distinct: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(w) for w in distinct.cast(pa.binary()).to_pylist()], np.int64) % BUCKETS


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of every bucket the places of its index vector's entries, and their signs."""
    drawn = np.random.default_rng(SEED)
    places = drawn.permuted(np.tile(np.arange(DIM), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    return places, np.where(drawn.random((BUCKETS, NONZERO)) < 0.5, -1, 1)


def context_vectors(docs: DataFrame) -> DataFrame:
    """bucket, and the sums d0, d1, ... of the index vectors around its words."""
    names = [f"d{i}" for i in range(DIM)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros((BUCKETS, DIM), np.int64)
        for batch in batches:
            column = batch.column("text")
            for start, stop in pieces(column):
                words = sign_words(column.slice(start, stop - start))
                rows, owner, codes = buckets_of(words.distinct), words.owner, words.codes
                at, weight = places[rows], signs[rows]
                local = np.zeros(len(rows) * DIM)
                for gap in range(1, WINDOW + 1):
                    near = np.flatnonzero(owner[gap:] == owner[:-gap])
                    for a, b in ((codes[near], codes[near + gap]), (codes[near + gap], codes[near])):
                        for k in range(NONZERO):
                            local += np.bincount(a * DIM + at[b, k], weight[b, k], len(local))
                np.add.at(total, rows, local.astype(np.int64).reshape(-1, DIM))
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(total[some, i]) for i in range(DIM)]], names=["bucket", *names])

    schema = ", ".join(["bucket bigint", *[f"{c} bigint" for c in names]])
    return docs.select("text").mapInArrow(gather, schema).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS rows of DIM, of length UNIT each, or 0 where no word has a neighbour."""
    table = np.zeros((BUCKETS, DIM), np.float64)
    rows = context_vectors(docs).toArrow()
    table[rows.column("bucket").to_numpy()] = np.column_stack([rows.column(f"d{i}").to_numpy() for i in range(DIM)])
    lengths = np.linalg.norm(table, axis=1, keepdims=True)
    return np.round(UNIT * table / np.where(lengths > 0, lengths, 1)).astype(np.int16)


FEATURES = 2 * DIM + 3


def pooled(words: Words, vectors: np.ndarray) -> np.ndarray:
    """FEATURES numbers of each text: mean and spread of its words' vectors, how alike neighbours are, how alike words
    are to the mean, and the logarithm of the number of words."""
    table = (vectors[buckets_of(words.distinct)] / np.float32(UNIT)).astype(np.float32)
    out = np.zeros((len(words.sizes), FEATURES))
    for i in np.flatnonzero(words.sizes):
        codes = words.codes[words.ends[i] : words.ends[i + 1]]
        n, total, square, alike = len(codes), np.zeros(DIM), np.zeros(DIM), 0.0
        for at in range(0, n, POOLED_WORDS):
            # One word more than are summed, as the neighbour of the last.
            each = table.take(codes[at : at + POOLED_WORDS + 1], axis=0)
            alike += float(np.einsum("ij,ij->", each[1:], each[:-1]))
            each = each[:POOLED_WORDS]
            total += each.sum(axis=0)
            square += np.einsum("ij,ij->j", each, each)
        mean = total / n
        spread = np.sqrt(np.maximum(square / n - mean * mean, 0))
        out[i] = [*mean, *spread, alike / max(n - 1, 1), np.sqrt(mean @ mean), np.log1p(n)]
    return out


def of_texts(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(column), FEATURES))
    for start, stop in pieces(column):
        out[start:stop] = pooled(sign_words(column.slice(start, stop - start)), vectors)
    return np.round(out, 5)


@dataclass
class Network:
    """Two layers: tanh units, then one logit. Inputs are standardised."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        # Row by row in one order of summing, so that equal rows get equal logits.
        hidden = np.tanh(np.einsum("ij,jk->ik", (x - self.centre) / self.scale, self.w1) + self.b1)
        return np.einsum("ij,j->i", hidden, self.w2) + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def loss(z: np.ndarray, y: np.ndarray) -> float:
    """Mean negative log likelihood of labels under logits."""
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train_network(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> Network:
    """Adam on mini-batches of the rows that are not ``apart``; those decide when to stop and the temperature."""
    drawn = np.random.default_rng(SEED)
    own, own_y = (x[~apart], y[~apart]) if (~apart).any() else (x, y)
    check, check_y = (x[apart], y[apart]) if apart.any() else (own, own_y)
    centre, scale = own.mean(axis=0), own.std(axis=0)
    net = Network(
        centre, np.where(scale > 1e-9, scale, 1.0), drawn.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        drawn.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1),
    )
    given = (own - net.centre) / net.scale
    names = ("w1", "b1", "w2", "b2")
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    best, least, step = {k: getattr(net, k).copy() for k in names}, loss(net.logits(check), check_y), 0
    for _ in range(EPOCHS):
        order = drawn.permutation(len(given))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            a, t = given[rows], own_y[rows]
            hidden = np.tanh(a @ net.w1 + net.b1)
            off = (sigmoid(hidden @ net.w2 + net.b2) - t) / len(rows)
            back = np.outer(off, net.w2) * (1 - hidden**2)
            slopes = {"w1": a.T @ back + DECAY * net.w1, "b1": back.sum(axis=0), "w2": hidden.T @ off + DECAY * net.w2, "b2": off.sum(keepdims=True)}
            step += 1
            for k, g in slopes.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                setattr(net, k, getattr(net, k) - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
        if (now := loss(net.logits(check), check_y)) < least:
            best, least = {k: getattr(net, k).copy() for k in names}, now
    for k, v in best.items():
        setattr(net, k, v)
    net.temperature = best_temperature(net.logits(check), check_y)
    return net


def best_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits, from 1/8 to 8, under which the labels are likeliest."""
    grid = np.exp(np.linspace(-np.log(8), np.log(8), 97))
    return float(grid[int(np.argmin([loss(z / t, y) for t in grid]))])


def labelled(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """doc_id, text, y of the sample to learn from: at most TRAIN_ROWS labels, which find their texts without a shuffle of these."""
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max("quality").cast("int").alias("y")).where(usable)
    marks = written(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS), "marks")
    return written(docs.join(F.broadcast(marks), "doc_id").dropDuplicates(["doc_id"]), "train")


def score(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """doc_id, score for every document; learns from the labelled rows that ``usable`` (of doc_id) admits."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(long_id(docs), "text")
    train = labelled(base, labels, usable)
    share = train.agg(F.avg("y")).first()[0]
    if share in (None, 0.0, 1.0):
        return base.select("doc_id", F.lit(float(share or 0.0)).alias("score"))
    vectors = spark.sparkContext.broadcast(word_vectors(base))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = of_texts(b.column("text"), vectors.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = train.mapInArrow(features, "doc_id bigint, y int, x array<double>").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(FOLDS)))
    sample = rows.toArrow().sort_by("doc_id")
    x = np.array(sample.column("x").combine_chunks().flatten()).reshape(-1, FEATURES)
    net = spark.sparkContext.broadcast(train_network(x, sample.column("y").to_numpy().astype(float), sample.column("fold").to_numpy() == 0))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(net.value.score(of_texts(b.column("text"), vectors.value)))], names=["doc_id", "score"])

    return base.mapInArrow(scores, "doc_id bigint, score double")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Without an id nothing says that a row may be learned from.
    out = score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), F.coalesce(~held_out(), F.lit(False)))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
