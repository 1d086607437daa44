"""Requests from end to end: redacted under stored policies, with contexts, ledger and counters kept in the same call."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablework.operators.metrics import RedactionMetrics
from sablework.plans.engine import redact_requests
from sablework.sources.ledger import ENTRY, TAIL, Ledger
from sablework.sources.stores import ContextStore, PolicyStore, context_entries, folders


class RedactionService:
    """Policies, contexts, ledger and results under one folder.

    Results are written once, and what contexts, ledger and counters need is read from there, so texts are searched once. Contexts
    and ledger follow the results: a call that fails between them leaves results that no store has seen, and raises.
    """

    def __init__(self, spark: SparkSession, home: str, ledger: Ledger | None = None) -> None:
        self.spark, self.home = spark, home.rstrip("/")
        self.policies = PolicyStore(spark, f"{self.home}/policies")
        self.contexts = ContextStore(spark, f"{self.home}/contexts")
        self.ledger, self.counts = ledger or Ledger(), RedactionMetrics()

    def redact(self, requests: DataFrame, **engine) -> DataFrame:
        """Requests as redact_requests() takes them, with error, spans and filtered_text. A boolean column ``ledger`` says whose spans are recorded
        (without it, none are). Spans of requests with a context go into its store."""
        asked = requests if "ledger" in requests.columns else requests.withColumn("ledger", F.lit(False))
        out = redact_requests(asked, self.policies.table.read(), **engine)
        done = self._written(out)
        self.contexts.put(context_entries(done, "document_id"))
        self._record(done.where("ledger"))
        return done if "ledger" in requests.columns else done.drop("ledger")

    def explain(self, requests: DataFrame, **engine) -> DataFrame:
        """The same without filtered texts; contexts and ledger stay as they are."""
        return self._written(redact_requests(requests, self.policies.table.read(), explain_only=True, **engine))

    def _written(self, out: DataFrame) -> DataFrame:
        path = f"{self.home}/results/{uuid.uuid4().hex}"
        self.counts.watch(out).write.parquet(path)
        return self.spark.read.schema(out.schema).parquet(path)

    def _record(self, done: DataFrame) -> None:
        part = f"part={uuid.uuid4().hex}"
        entries = self.ledger.record(done, F.current_timestamp(), tails=self._tails())
        entries.write.parquet(f"{self.home}/ledger/{part}")
        self.ledger.tails(self.spark.read.schema(ENTRY).parquet(f"{self.home}/ledger/{part}")).write.parquet(f"{self.home}/tails/{part}")

    def _tails(self) -> DataFrame:
        if not folders(self.spark, f"{self.home}/tails"):
            return self.spark.createDataFrame([], TAIL)
        ends = self.spark.read.schema(TAIL).parquet(f"{self.home}/tails")
        return ends.groupBy("document_id").agg(F.max(F.struct("index", "hash")).alias("t")).select("document_id", "t.index", "t.hash")

    def entries(self) -> DataFrame:
        """The whole ledger, as it is stored."""
        if not folders(self.spark, f"{self.home}/ledger"):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.home}/ledger")

    def history(self, document_id: str) -> DataFrame:
        return self.ledger.get(self.entries(), document_id)

    def verify(self, document_id: str) -> bool:
        return self.ledger.verify(self.entries(), document_id)

    def metrics(self) -> DataFrame:
        return self.counts.row(self.spark, self.contexts.list())
