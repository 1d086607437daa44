"""Operator 13: k-means by Lloyd's rounds, sharded by dimension.

Vectors become integers, floor(SCALE * x), and are laid out once as a table of blocks:
BLOCK_DIMS columns of CHUNK_ROWS vectors each. A round has two steps. First each block
computes the exact partial distances of its columns to the centroids' slices, and
reduceByKey adds the blocks of a chunk, whose nearest centroids are then the smallest
sums. Then the chunk's cluster numbers go back to its blocks, which stay where they are
(both sides have one partitioner), and each shard of columns adds up its own slice of
every centroid. A task holds one block at a time; the driver sees only CLUSTERS x
dimensions integers a round. The table of blocks is written to the shared folder, so
what a lost executor held is read again from there.

Kept are vectors of exactly ``dims`` components, none null or NaN or infinite; null and
shorter vectors are left out. Integers beyond +-2^27 count as that, so that squared
distances fit a long (inertia ends at the largest long). A vector as near to two
centroids goes to the smaller number; a centroid without vectors stays. Equal vectors are
vectors of their own; a null vec_id hashes as the empty text, and of equal hashes the
smaller vector comes first. With fewer vectors than clusters there are as many centroids
as vectors; no vector gives an empty result. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, written

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
BLOCK_DIMS = 32
CHUNK_ROWS = 1024
MOST = 1 << 27


def kept(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id, x (array of doubles): the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    usable = (F.size("x") == dims) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x")).where(F.coalesce(usable, F.lit(False)))


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.clip(np.floor(scale * x), -MOST, MOST).astype(np.int64)


def narrow(a: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    return a.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in the order of these."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(text, 256).alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    return integers(np.array([r.x for r in rows], np.float64), scale)


def blocks_table(vectors: DataFrame, dims: int = DIMS, width: int = BLOCK_DIMS, rows: int = CHUNK_ROWS, scale: int = SCALE) -> DataFrame:
    """chunk, block, ids, data: the vectors' integers by chunks of rows and blocks of columns, written. ``ids`` (8 bytes
    each) and ``no_id`` (one each) come with block 0."""

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                values = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)
                ints, ids = integers(values, scale), part.column("vec_id")
                places = [narrow(ints[:, i : i + width]) for i in range(0, dims, width)]
                none = [None] * (len(places) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(range(len(places))), pa.int32()), pa.array([p.dtype.name for p in places]), pa.array([len(part)] * len(places), pa.int32()),
                        pa.array([p.tobytes() for p in places], pa.binary()), pa.array([ids.fill_null(0).to_numpy().tobytes(), *none], pa.binary()),
                        pa.array([ids.is_null().to_numpy(zero_copy_only=False).tobytes(), *none], pa.binary()),
                    ],
                    names=["block", "kind", "n", "data", "ids", "no_id"],
                )

    laid = vectors.select("vec_id", "x").mapInArrow(lay_out, "block int, kind string, n int, data binary, ids binary, no_id binary")
    # A chunk's blocks come one after the other from one task, so counting rows numbers the chunks.
    number = F.monotonically_increasing_id() - F.col("block")
    return written(laid.withColumn("chunk", number), "blocks")


def distances(block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids, in the columns at hand."""
    a, c = block.astype(np.int64), centroids.astype(np.int64)
    out = np.empty((len(a), len(c)), np.int64)
    for k, centroid in enumerate(c):
        d = a - centroid
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


def nearest(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the cluster (the smaller number in a tie) and the distance."""
    cluster = sums.argmin(axis=1)
    return narrow(cluster), sums[np.arange(len(sums)), cluster]


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return narrow(a.astype(np.int64) + b)


def assign(blocks: RDD, centroids: dict[int, np.ndarray], partitions: int) -> RDD:
    """Per chunk: cluster and distance of each row."""
    partial = blocks.map(lambda kv: (kv[0][1], narrow(distances(kv[1], centroids[kv[0][0]]))))
    return partial.reduceByKey(add, partitions).mapValues(nearest)


def moved(blocks: RDD, chosen: RDD, centroids: dict[int, np.ndarray], partitions: int) -> dict[int, np.ndarray]:
    """The centroids' slices after a round: each shard of columns takes the floor of its rows' means."""
    numbers = list(centroids)
    k = len(centroids[numbers[0]])

    def sums(pair: tuple) -> tuple[np.ndarray, np.ndarray]:
        block, cluster = pair
        out = np.zeros((k, block.shape[1]), np.int64)
        np.add.at(out, cluster, block.astype(np.int64))
        return out, np.bincount(cluster, minlength=k)

    back = chosen.flatMap(lambda kv: [((b, kv[0]), kv[1][0]) for b in numbers]).partitionBy(partitions)
    both = blocks.join(back, partitions)
    totals = both.map(lambda kv: (kv[0][0], sums(kv[1]))).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), len(numbers))
    slices = totals.map(lambda kv: (kv[0], np.where(kv[1][1][:, None] > 0, kv[1][0] // np.maximum(kv[1][1], 1)[:, None], centroids[kv[0]])))
    return dict(slices.collect())


def lloyd(vectors: DataFrame, dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, width: int = BLOCK_DIMS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    small_batches(spark)
    usable = kept(vectors, dims)
    start = first_centroids(usable, clusters, scale, seed)
    schema = "vec_id bigint, cluster int, distance bigint"
    if not len(start):
        empty = usable.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    table = blocks_table(usable, dims, width, scale=scale)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    of_row = lambda r: ((r.block, r.chunk), np.frombuffer(r.data, r.kind).reshape(r.n, -1))
    blocks = table.select("block", "chunk", "kind", "n", "data").rdd.map(of_row).partitionBy(n).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centroids = {b: start[:, i : i + width] for b, i in enumerate(range(0, dims, width))}
        for _ in range(rounds):
            centroids = moved(blocks, assign(blocks, centroids, n), centroids, n)
        ids = table.where("block = 0").select("chunk", "ids", "no_id").rdd.map(lambda r: (r.chunk, (r.ids, r.no_id)))

        def rows(kv: tuple) -> list[tuple]:
            (cluster, distance), (raw, no_id) = kv[1]
            named = zip(np.frombuffer(raw, np.int64).tolist(), np.frombuffer(no_id, bool).tolist(), cluster.tolist(), distance.tolist(), strict=True)
            return [(None if no else i, c, d) for i, no, c, d in named]

        last = assign(blocks, centroids, n)
        out = written(spark.createDataFrame(last.join(ids, n).flatMap(rows), schema), "assigned")
    finally:
        blocks.unpersist()
    whole = np.hstack([centroids[b] for b in sorted(centroids)])
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(whole.tolist())]
    # One row per cluster from here on.
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    fits = lambda c: F.least(c, most).cast("long")
    by_cluster = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"))
    total = F.sum("s").over(Window.partitionBy())
    facts = by_cluster.select("cluster", fits(F.col("s").cast("decimal(38,0)")).alias("cluster_inertia"), fits(total.cast("decimal(38,0)")).alias("inertia"))
    facts = facts.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round(i: int) -> str:
    """Assignments to the centroids of round ``i``, and the centroids after it."""
    return f"""
a{i} AS (SELECT id, x, h[2] AS cluster, h[1] AS distance FROM (
    SELECT id, x, list_min(list_transform(cs, lambda c, j: [list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, j - 1])) AS h
    FROM v, l{i})),
e{i} AS (SELECT cluster, d, floor(sum(value) / count(*))::BIGINT AS m FROM (SELECT cluster, unnest(x) AS value, generate_subscripts(x, 1) AS d FROM a{i}) GROUP BY ALL),
m{i} AS (SELECT cluster, list(m ORDER BY d) AS c FROM e{i} GROUP BY cluster),
l{i + 1} AS (SELECT list(coalesce(m.c, o.c) ORDER BY o.j) AS cs FROM (SELECT unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS j FROM l{i}) o LEFT JOIN m{i} m ON m.cluster = o.j)"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (
    SELECT vec_id AS id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
),
l0 AS (SELECT list(x ORDER BY h) AS cs FROM (SELECT x, sha256('{SEED}:' || id) AS h FROM v ORDER BY h LIMIT {CLUSTERS})),
{",".join(_round(i).replace(" AS (", " AS MATERIALIZED (", 1) for i in range(ROUNDS + 1))},
centroids AS (SELECT generate_subscripts(cs, 1) - 1 AS cluster, sha256(array_to_string(unnest(cs), ',')) AS centroid_sha256 FROM l{ROUNDS})
SELECT id AS vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
    (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN centroids USING (cluster)
"""
