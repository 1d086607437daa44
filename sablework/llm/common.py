"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group that holds more than one row in HEAVY of all rows is "heavy"; there are at most HEAVY of them.
HEAVY = 1000


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (local tests) a temporary folder of this machine is used.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("sablework.local.checkpoint.dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="sablework-")
            spark.conf.set("sablework.local.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sablework-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def located(docs: DataFrame, **columns: str) -> DataFrame:
    """``docs`` with further columns, SQL of ``_metadata`` (file and row of a file). Tables read from Parquet have it;
    others are written first."""
    with_columns = lambda df: df.select("*", *[F.expr(c).alias(name) for name, c in columns.items()])
    try:
        return with_columns(docs)
    except AnalysisException:
        return with_columns(written(docs, "located"))


#: What tells the rows of a table apart, for located().
ROW = {"__file": "xxhash64(_metadata.file_path)", "__row": "_metadata.row_index"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def long_id(df: DataFrame, column: str = "doc_id") -> Column:
    """The id as a bigint; the plain column where it is one. (An alias would be taken away on one side of a self-join
    only, and exchanges that could be shared would differ.)"""
    return F.col(column) if dict(df.dtypes)[column] == "bigint" else F.col(column).cast("long").alias(column)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows to a Python worker at a time: texts may be long, and a worker's memory is small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def left_join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of many rows with one row per group, where a group may hold a third of all rows.

    Groups of at least total / HEAVY rows are at most HEAVY in number, so they
    are broadcast; what is left shuffles on the key, with no group above that
    share. ``groups`` is unique on ``key`` and carries its rows' number in
    ``size``; its other columns are added to ``rows``, null where none fits.
    """
    limit = max(1000, -(-total // HEAVY))
    value = F.struct(*[c for c in groups.columns if c != key])
    heavy = groups.where(F.col(size) >= limit).select(F.col(key).alias("_hk"), value.alias("_heavy"))
    light = groups.where(F.col(size) < limit).select(F.col(key).alias("_lk"), value.alias("_light"))
    # Rows of a heavy group look for a light key that isn't there, spread over all tasks.
    nowhere = F.when(F.col("_heavy").isNull(), F.col(key))
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left").withColumn("_k", nowhere)
    found = out.where(F.col("_k").isNotNull()).join(light, F.col("_k") == F.col("_lk"), "left")
    rest = out.where(F.col("_k").isNull())
    names = [c for c in groups.columns if c != key]
    one = found.select(*rows.columns, *[F.col(f"_light.{c}").alias(c) for c in names])
    two = rest.select(*rows.columns, *[F.col(f"_heavy.{c}").alias(c) for c in names])
    return one.unionByName(two)
