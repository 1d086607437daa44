"""Operator 11: importance resampling towards the distribution of a target text collection.

Features of a text are its runs of 1 to ORDERS consecutive words, repeats counted,
hashed into BUCKETS by CRC-32. How much more likely a bucket is in the target than
in the corpus is its gain; a document weighs the sum of its features' gains. Adding
a draw of its own (Gumbel noise from a hash of its id) to each weight and taking the
highest scores is sampling without replacement in proportion to the weights.

Two passes over the texts, both without a shuffle of texts: the first counts buckets
(each task sends at most BUCKETS rows), the second looks gains up. In both, words are
split, flattened and dictionary-encoded by Arrow kernels, an n-gram is a pair of an
(n-1)-gram's number and the number of the word after it, and only distinct n-grams
are hashed. The BUCKETS gains are all that passes through the driver. Ranks come from
a range exchange of narrow rows: each range is numbered by itself and starts where
the ranges above it end.

Null and empty texts and texts without a word have no feature, weigh 0 and are never
drawn (they have too few words); their score is still given. Repeated rows are
documents of their own with equal scores; among equal scores the smaller doc_id comes
first, a null id (hashed as the empty text) last, and rows that are equal throughout
in the order of the table. Very long texts are one piece of work each. An empty corpus
gives an empty result, an empty target gains from the smoothing alone. Columns other
than doc_id and text aren't looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_words import Words, pieces, split_words, sums_by_text
from .common import documents, long_id, small_batches, written

ORDERS = 1
BUCKETS = 10_000
SEED = 2024
#: Documents with fewer words aren't drawn; of the others so many in a hundred are.
MIN_WORDS, PERCENT = 20, 10
#: What lies between words: ASCII that is neither digit nor small letter.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_words(texts: pa.Array) -> Words:
    return split_words(texts, lambda t: pc.split_pattern_regex(pc.ascii_lower(t), BETWEEN))


def feature_buckets(words: Words, orders: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per length n of 1 to ``orders``: the bucket of each n-gram, and where each text's n-grams end (from 0 on)."""
    distinct, codes, ends = words.distinct, words.codes, words.ends
    owner = words.owner
    for n in range(1, orders + 1):
        if n > 1:
            # The n-gram at i is the (n-1)-gram at i and the word n - 1 further on, where that is of the same text.
            inside = owner[: len(owner) - n + 1] == owner[n - 1 :] if len(owner) >= n else np.zeros(0, bool)
            at = np.flatnonzero(inside)
            pairs = codes_at(codes, previous_at, at) * max(1, len(words.distinct)) + words.codes[at + n - 1]
            seen, codes = np.unique(pairs, return_inverse=True)
            left, right = np.divmod(seen, max(1, len(words.distinct)))
            distinct = pc.binary_join_element_wise(distinct.take(pa.array(left)), words.distinct.take(pa.array(right)), " ")
            ends = np.searchsorted(at, words.ends)
            previous_at = at
        else:
            previous_at = np.arange(len(codes))
        hashes = np.fromiter((zlib.crc32(w.encode()) % buckets for w in distinct.to_pylist()), np.int64, len(distinct))
        yield hashes.take(codes), ends


def codes_at(codes: np.ndarray, places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The codes at ``wanted``, of codes that stand at the (sorted) ``places``."""
    return codes[np.searchsorted(places, wanted)]


def bucket_counts(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n of all features of the column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            column = batch.column("text")
            for start, stop in pieces(column):
                for found, _ in feature_buckets(lower_words(column.slice(start, stop - start)), orders, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, in thousandths of a natural logarithm, rounded down."""
    s, t = ({r.bucket: r.n for r in bucket_counts(x, orders, buckets).collect()} for x in (corpus, target))
    total_s, total_t = (float(sum(x.values()) + buckets) for x in (s, t))
    ratio = lambda b: (t.get(b, 0) + 1.0) * total_s / ((s.get(b, 0) + 1.0) * total_t)
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def weigh(docs: DataFrame, gain: list[int], orders: int = ORDERS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs``."""
    table, buckets = np.array(gain, np.int64), len(gain)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            made = np.zeros((3, len(column)), np.int64)
            for start, stop in pieces(column):
                words = lower_words(column.slice(start, stop - start))
                made[0, start:stop] = words.sizes
                for found, ends in feature_buckets(words, orders, buckets):
                    made[1, start:stop] += np.diff(ends)
                    made[2, start:stop] += sums_by_text(table.take(found), ends)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, made)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(long_id(docs), "text").mapInArrow(of_batches, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A document's draw: Gumbel noise in thousandths, from the first 32 bits of a hash of its id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def with_ranks(rows: DataFrame, drawable: Column, percent: int = PERCENT) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3... of the drawn ones by score, null for others."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.withColumns({"drawable": drawable, "row": F.monotonically_increasing_id()}), "scored")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    dealt = rows.where("drawable").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row per partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    above = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"), F.sum("n").over(Window.partitionBy()).alias("drawable_rows"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    place = dealt.withColumn("within", within).join(F.broadcast(above), "part").withColumn("place", F.col("above") + F.col("within"))
    drawn = F.when(F.col("place") <= F.floor(F.lit(percent) * F.col("drawable_rows") / 100), F.col("place"))
    ranked = place.withColumn("rank", drawn.cast("long")).select(*rows.columns, "rank")
    return ranked.unionByName(rows.where("not drawable").withColumn("rank", F.lit(None).cast("long"))).drop("drawable", "row")


def resample(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text), drawn towards ``target`` (text)."""
    small_batches(docs.sparkSession)
    weighed = weigh(docs, gains(docs, target, orders, buckets), orders)
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return with_ranks(scored, F.col("n_words") >= min_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
#: The same as SQL: CRC-32 by its table (from its polynomial, eight steps each), on distinct words.
OP11_SQL = f"""
WITH RECURSIVE steps AS (
    SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, {_STEP}, k + 1 FROM steps WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
b AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
vocabulary AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION ALL SELECT w FROM b)),
hashed AS (
    SELECT w, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda p: ('0x' || substr(h, p, 2))::BIGINT)),
        lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295) % {BUCKETS} AS bucket
    FROM vocabulary, crc
),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN hashed USING (w) GROUP BY bucket),
gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE
        / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS g
    FROM (SELECT unnest(range({BUCKETS})) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
),
weights AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
    SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM d LEFT JOIN weights USING (doc_id)
),
ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {MIN_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
