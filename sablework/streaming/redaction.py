"""Redaction of streams. The engine's plan is narrow, so it runs on a stream unchanged; stores follow by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sablework.plans.engine import Engine
from sablework.sources.ledger import ENTRY, TAIL, Ledger
from sablework.sources.stores import ContextStore, context_entries, folders


#: After so many batches, a batch writes the ends of all chains rather than those it has moved.
MERGE_EVERY = 50


def redact_stream(stream: DataFrame, engine: Engine, **columns) -> DataFrame:
    """A streaming DataFrame with spans and filtered text."""
    return engine.redact(stream, **columns)


def token_rate(stream: DataFrame, time: str, window: str, late: str, text: str = "text") -> DataFrame:
    """Documents and redactions per time window, late rows up to ``late`` counted (the stream must have spans)."""
    seen = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"))
    return seen.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("spans")).alias("redactions"))


def with_stores(contexts: ContextStore | None = None, ledger: Ledger | None = None, ledger_path: str | None = None, order: str = "document_id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps contexts and ledger up to date with each batch of redacted documents.

    A batch that is run again replaces its own part of the ledger, so entries aren't doubled. Batches never read the
    ledger: each leaves the ends of the chains that it has moved beside it, under ``{ledger_path}_tails``, and reads the
    parts since the last one that has them all. A query with a new checkpoint goes on from what others have left; its parts bear
    its id. One query at a time may write to a ledger.
    """

    def part(run: str | None, epoch: int) -> str:
        return f"epoch={epoch}-{run}" if run else f"epoch={epoch}"

    def tails_before(spark: SparkSession, run: str | None, epoch: int) -> DataFrame:
        home = f"{ledger_path}_tails"
        if epoch:
            first = (epoch - 1) // MERGE_EVERY * MERGE_EVERY
            parts = [part(run, e) for e in range(first, epoch)]
        else:
            parts = [name for name in folders(spark, home) if name != part(run, 0)]
            if parts and not run:
                raise ValueError(f"{ledger_path} has entries of other batches; only a stream goes on from these")
        if not parts:
            return spark.createDataFrame([], TAIL)
        return newest(spark.read.schema(TAIL).parquet(*[f"{home}/{p}" for p in parts]))

    def newest(tails: DataFrame) -> DataFrame:
        last = tails.groupBy("document_id").agg(F.max(F.struct("index", "hash")).alias("t"))
        return last.select("document_id", "t.index", "t.hash")

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if contexts:
            contexts.put(context_entries(batch, order))
        if ledger and ledger_path:
            run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
            before, own = tails_before(spark, run, epoch), part(run, epoch)
            ledger.record(batch, F.current_timestamp(), tails=before).write.mode("overwrite").parquet(f"{ledger_path}/{own}")
            moved = ledger.tails(spark.read.schema(ENTRY).parquet(f"{ledger_path}/{own}"))
            after = newest(before.unionByName(moved)) if epoch % MERGE_EVERY == 0 else moved
            after.write.mode("overwrite").parquet(f"{ledger_path}_tails/{own}")

    return apply


def start(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
