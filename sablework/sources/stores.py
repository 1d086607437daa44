"""Policies and context mappings as tables of a catalogue-free folder: Parquet, versioned by write.

Every change writes a new version beside the old ones and only then names it as
the current one, so a reader sees a whole version, and a lost executor or a
failed write leaves the last one in place. Reads and writes go through Spark, so
any file system that Spark knows will do.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sablework.plans.policy import parse_policy


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below ``spark.checkpoint.dir``, or, where that is unset (local
    tests), a temporary folder of this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="sablework-")
    return f"{base.rstrip('/')}/stores-{uuid.uuid4().hex}"


class NotFound(KeyError):
    pass


class AlreadyExists(ValueError):
    pass


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds; none if it isn't there."""
    fs, root = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []


class VersionedTable:
    """One table under ``path``: numbered versions, the largest finished one counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        done = [p for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{versions[-1]}")

    def replace(self, rows: DataFrame) -> None:
        """The new content; it may be derived from the present one."""
        rows.write.parquet(f"{self.path}/v{(self._versions() or [-1])[-1] + 1}")


class PolicyStore:
    """Named policies: create, get, update, delete, list."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = VersionedTable(spark, path, "name string, policy string")
        self.spark = spark

    def _put(self, name: str, policy: str | Mapping) -> None:
        parse_policy(policy)
        text = policy if isinstance(policy, str) else json.dumps(policy)
        row = self.spark.createDataFrame([(name, text)], self.table.schema)
        self.table.replace(self.table.read().where(F.col("name") != name).unionByName(row))

    def list(self) -> list[str]:
        return sorted(r.name for r in self.table.read().select("name").collect())

    def find(self, name: str) -> str | None:
        row = self.table.read().where(F.col("name") == name).first()
        return row.policy if row else None

    def get(self, name: str) -> str:
        if (found := self.find(name)) is None:
            raise NotFound(name)
        return found

    def create(self, name: str, policy: str | Mapping) -> None:
        if self.find(name) is not None:
            raise AlreadyExists(name)
        self._put(name, policy)

    def update(self, name: str, policy: str | Mapping) -> None:
        self.get(name)
        self._put(name, policy)

    def delete(self, name: str) -> None:
        """Also fine if there is none."""
        self.table.replace(self.table.read().where(F.col("name") != name))

    def as_dict(self) -> dict[str, str]:
        return {r.name: r.policy for r in self.table.read().collect()}


def token_hash(token: Column) -> Column:
    return F.sha2(token.cast("binary"), 256)


def context_entries(explained: DataFrame, order: str | Column, spans: str = "spans") -> DataFrame:
    """context, token_hash, replacement, seq of every span (ignored ones too) that has a context. ``order`` ranks the
    documents; within one, spans follow their order."""
    rank = F.col(order) if isinstance(order, str) else order
    rows = explained.select(rank.alias("__rank"), F.posexplode_outer(spans).alias("__pos", "s")).where(F.col("s.context") != "")
    return rows.select(
        F.col("s.context").alias("context"), token_hash(F.col("s.text")).alias("token_hash"), F.col("s.replacement").alias("replacement"),
        F.struct("__rank", "__pos").alias("seq"),
    )


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (context, token_hash): of the new entries the last, else the old one."""
    last = new.groupBy("context", "token_hash").agg(F.max_by("replacement", "seq").alias("replacement"))
    both = old.withColumn("fresh", F.lit(0)).unionByName(last.withColumn("fresh", F.lit(1)))
    return both.groupBy("context", "token_hash").agg(F.max_by("replacement", "fresh").alias("replacement"))


#: What an entry is found by, and how many buckets a new context store has.
KEY = ("context", "token_hash")
BUCKETS = 64


class BucketedTable:
    """A table under ``path`` in buckets by a hash of KEY. A change writes the buckets that it touches to a new folder, then a
    manifest that says where each bucket is; the manifest with the largest number counts, and only one writer can claim a number."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def manifest(self) -> tuple[int, dict[int, str]]:
        """The number of the last change (-1 if none), and the folder of each bucket that has rows."""
        numbers = sorted(int(n.removesuffix(".json")) for n in folders(self.spark, f"{self.path}/manifests") if n.endswith(".json"))
        if not numbers:
            return -1, {}
        text = self.spark.read.text(f"{self.path}/manifests/{numbers[-1]:010d}.json", wholetext=True).first().value
        found = json.loads(text)
        self.buckets = found["buckets"]
        return numbers[-1], {int(b): f for b, f in found["folders"].items()}

    def _claim(self, number: int, where: dict[int, str]) -> None:
        fs, path = _file_system(self.spark, f"{self.path}/manifests/{number:010d}.json")
        text = json.dumps({"buckets": self.buckets, "folders": where})
        draft = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(path.getParent())
        # Renaming doesn't replace a file that another writer has put there.
        if fs.exists(path) or not fs.rename(draft, path):
            raise AlreadyExists(f"{self.path}: another writer has made change {number}")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        where = self.manifest()[1]
        paths = [f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(where.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def change(self, touched: list[int], rows: DataFrame) -> None:
        """The new content of some buckets, which may be derived from the present one."""
        number, where = self.manifest()
        folder = uuid.uuid4().hex
        dealt = rows.withColumn("bucket", self.bucket()).repartition(max(1, min(len(touched), self.buckets)), "bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        full = [int(n.removeprefix("bucket=")) for n in folders(self.spark, f"{self.path}/data/{folder}") if n.startswith("bucket=")]
        kept = {b: f for b, f in where.items() if b not in set(touched)}
        self._claim(number + 1, kept | dict.fromkeys(full, folder))


class ContextStore:
    """Which replacement a token got in a context; tokens are kept as hashes. Changes rewrite the buckets that they touch,
    and looking a token up reads one bucket."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.table = BucketedTable(spark, path, "context string, token_hash string, replacement string", buckets)
        self.spark = spark

    def put(self, entries: DataFrame) -> None:
        """Entries as context_entries() makes them."""
        self.table.manifest()
        path = f"{self.table.path}/incoming/{uuid.uuid4().hex}"
        last = entries.groupBy(*KEY).agg(F.max_by("replacement", "seq").alias("replacement"))
        last.withColumn("bucket", self.table.bucket()).write.parquet(path)
        new = self.spark.read.schema(f"{self.table.schema}, bucket int").parquet(path)
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        if touched:
            fresh = new.drop("bucket").withColumn("seq", F.lit(0))
            self.table.change(touched, upsert(self.table.read(touched), fresh))

    def get(self, context: str, token: str) -> str | None:
        self.table.manifest()
        key = self.spark.createDataFrame([(context, token)], "context string, token string").select("context", token_hash(F.col("token")).alias("token_hash"))
        at = key.select("*", self.table.bucket().alias("bucket")).first()
        row = self.table.read([at.bucket]).where((F.col("context") == context) & (F.col("token_hash") == at.token_hash)).first()
        return row.replacement if row else None

    def lookup(self, tokens: DataFrame) -> DataFrame:
        """``tokens`` (context, token, ...) with the replacement that is stored, null where there is none."""
        keyed = tokens.withColumn("token_hash", token_hash(F.col("token")))
        return keyed.join(self.table.read(), list(KEY), "left").drop("token_hash")

    def delete(self, context: str) -> None:
        held = self.table.read().where(F.col("context") == context).select(self.table.bucket().alias("bucket"))
        touched = [r.bucket for r in held.distinct().collect()]
        if touched:
            self.table.change(touched, self.table.read(touched).where(F.col("context") != context))

    def list(self) -> DataFrame:
        return self.table.read().select("context").distinct()

    def counts(self) -> DataFrame:
        """context, count of all contexts."""
        return self.table.read().groupBy("context").count()

    def count(self, context: str) -> int:
        return self.table.read().where(F.col("context") == context).count()
