"""Operator 2: exact deduplication by a keyed state that lives on disk and never expires.

Arrivals (digest, stable id, content locator) stream through a Structured
Streaming aggregation whose state is kept by RocksDB: per digest the id and the
locator of the row that stays and the number of rows so far. A locator names the
file and the row of a text. Rows that hit a digest which is already there are
compared, byte by byte, with the text at the locator of the row that stays, so
two texts that share a digest never merge.

Of equal texts the row with the largest doc_id stays (ties: the largest
locator). Null text counts as empty; a null id loses against any id; very long
texts are compared whole; an empty table gives an empty result; repeated rows
(same id and text) each count in group_size and share one fate in ``kept``, while
only one of them is the row ``own = locator``. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, left_join_groups, located, long_id, shared_dir, text_or_empty, written

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    # Many small stores: no space is set aside ahead of need.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
ARRIVAL = "doc_id bigint, digest string, locator string"
CHANGE = "digest string, keep struct<doc_id:bigint,locator:string>, n_rows bigint, epoch bigint"
#: Where a text is: file and row.
LOCATOR = "concat(_metadata.file_path, '#', _metadata.row_index)"
#: Rows of one digest that one task compares with the content that stays.
ROWS_PER_SALT = 1000
#: Files of arrivals that one micro-batch takes in.
FILES_PER_BATCH = 1000


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


def stream_state(spark: SparkSession, arrivals: str, home: str) -> DataFrame:
    """Runs all arrivals not seen yet through the keyed state under ``home``; returns the state as one row per digest.

    A second call with more files in ``arrivals`` and the same ``home`` goes on from the state of the first.
    """
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        state = (
            spark.readStream.schema(ARRIVAL)
            .option("maxFilesPerTrigger", FILES_PER_BATCH)
            .parquet(arrivals)
            .groupBy("digest")
            .agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n_rows"))
        )
        spark.createDataFrame([], CHANGE).write.mode("overwrite").parquet(f"{home}/changes/epoch=-1")

        def emit(batch: DataFrame, epoch: int) -> None:
            changed = batch.withColumn("epoch", F.lit(epoch).cast("long"))
            changed.write.mode("overwrite").parquet(f"{home}/changes/epoch={epoch}")

        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{home}/state")
            .trigger(availableNow=True)
            .foreachBatch(emit)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.option("recursiveFileLookup", "true").schema(CHANGE).parquet(f"{home}/changes")
    # Every epoch tells the digests that it touched; the last word on a digest holds.
    last = changes.groupBy("digest").agg(F.max(F.struct("epoch", "keep", "n_rows")).alias("s"))
    return last.select(
        "digest",
        F.col("s.keep.doc_id").alias("keep_id"),
        F.col("s.keep.locator").alias("locator"),
        F.col("s.n_rows").alias("n_rows"),
    )


def collided_digests(rows: DataFrame, hits: DataFrame, total: int) -> DataFrame:
    """Digests whose rows do not all have the bytes of the row that stays, which its locator finds. A large group's
    content is laid out once per ROWS_PER_SALT rows, so that no task gets a whole hot group."""
    found = left_join_groups(rows, hits, "digest", "n_rows", total).where(F.col("n_rows").isNotNull())
    # The texts of all rows are dealt out once; those of hits are all that is used below. Read again, rows have numbers.
    found = written(found, "hits").withColumn("row", F.monotonically_increasing_id())
    salts = F.ceil(F.col("n_rows") / ROWS_PER_SALT).cast("long")
    members = found.where(F.col("own") != F.col("locator")).select("digest", "text", F.pmod(F.xxhash64("row"), salts).alias("salt"))
    stays = found.where(F.col("own") == F.col("locator")).select("digest", F.col("text").alias("kept_text"), "n_rows")
    stays = stays.select("digest", "kept_text", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    same = F.col("text").cast("binary") == F.col("kept_text").cast("binary")
    return members.join(stays, ["digest", "salt"]).where(~same).select("digest").distinct()


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256_of) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept, own and locator (of this row's text and of the
    one that stays).

    ``digest`` may be any SQL expression of the text; collisions cost time, never correctness.
    """
    return dedup_located(located(docs, __locator=LOCATOR), digest)


def dedup_located(docs: DataFrame, digest: Callable[[Column], Column] = sha256_of) -> DataFrame:
    """exact_dedup() of documents with a ``__locator``."""
    spark = docs.sparkSession
    home = shared_dir(spark)
    rows = docs.select(long_id(docs), text_or_empty().alias("text"), F.col("__locator").alias("own"))
    rows = rows.select("doc_id", digest(F.col("text")).cast("string").alias("digest"), "own", "text")
    rows.select("doc_id", "digest", F.col("own").alias("locator")).write.parquet(f"{home}/arrivals")
    arrivals = spark.read.schema(ARRIVAL).parquet(f"{home}/arrivals").withColumnRenamed("locator", "own")
    state = stream_state(spark, f"{home}/arrivals", home)
    total = arrivals.count()
    hits = state.where("n_rows > 1")
    collided = written(collided_digests(rows, hits, total), "collided")

    marked = left_join_groups(arrivals, hits, "digest", "n_rows", total)
    result = marked.select(
        "doc_id",
        "digest",
        F.when(F.col("n_rows").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n_rows", F.lit(1).cast("long")).alias("group_size"),
        "own",
        F.coalesce("locator", "own").alias("locator"),
    )
    if not collided.isEmpty():
        # The texts themselves are the key where a digest has several.
        several = rows.join(collided, "digest", "left_semi")
        true = several.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "own")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        true = true.select("digest", "text", F.col("keep.doc_id").alias("keep_id"), "group_size", F.col("keep.own").alias("locator"))
        mended = several.join(true, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size", "own", "locator")
        result = result.join(collided, "digest", "left_anti").unionByName(mended)
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts one row stays, the one that exact_dedup keeps.

    Rows are told apart by their locators, so one id on different texts loses
    none of them, and of rows without id or repeated rows one stays as well. An
    empty table stays empty; other columns pass through, whatever their names.
    """
    docs = located(docs, __locator=LOCATOR)
    gone = dedup_located(docs).where(F.col("own") != F.col("locator")).select(F.col("own").alias("__locator"))
    return docs.join(gone, "__locator", "left_anti").drop("__locator")
