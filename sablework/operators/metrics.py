"""Counters over redacted documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Unicode white space, as far as a word count minds it.
UNICODE_SPACE = r"[\t\n\x0B\f\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def token_count(text: Column) -> Column:
    """Words between Unicode white space; null text has none."""
    return F.coalesce(F.size(F.filter(F.split(text, UNICODE_SPACE), lambda w: w != "")), F.lit(0))


def counters(text: str = "text", spans: str = "spans") -> dict[str, Column]:
    """Aggregates over redacted documents: documents, tokens_received, redactions_total (ignored spans too)."""
    return {
        "documents": F.count(F.lit(1)),
        "tokens_received": F.coalesce(F.sum(token_count(F.col(text))), F.lit(0)).cast("bigint"),
        "redactions_total": F.coalesce(F.sum(F.size(spans)), F.lit(0)).cast("bigint"),
    }


def metrics(explained: DataFrame, contexts: DataFrame | None = None, text: str = "text", spans: str = "spans") -> DataFrame:
    """One row: documents, tokens_received, redactions_total (ignored spans too), contexts, healthy."""
    seen = explained.agg(*[c.alias(name) for name, c in counters(text, spans).items()])
    held = contexts.agg(F.countDistinct("context")).scalar() if contexts is not None else F.lit(0)
    return seen.withColumns({"contexts": held.cast("bigint"), "healthy": F.lit(1)})


class RedactionMetrics:
    """Counters that a redaction's own jobs keep, so nothing is searched twice: watch() redacted documents, write them, then ask."""

    def __init__(self, text: str = "text", spans: str = "spans") -> None:
        self.aggregates = [c.alias(name) for name, c in counters(text, spans).items()]
        self.watched: list[Observation] = []

    def watch(self, redacted: DataFrame) -> DataFrame:
        """The same rows; one job on them counts (of a table that several jobs read, write it first)."""
        self.watched.append(Observation(f"redaction-{uuid.uuid4().hex}"))
        return redacted.observe(self.watched[-1], *self.aggregates)

    def totals(self) -> dict[str, int]:
        """The sums over all watched tables; waits for those that no job has used yet."""
        found = [o.get for o in self.watched]
        return {name: sum(f[name] for f in found) for name in ("documents", "tokens_received", "redactions_total")}

    def row(self, spark: SparkSession, contexts: DataFrame | None = None) -> DataFrame:
        """The totals as metrics() has them."""
        schema = "documents bigint, tokens_received bigint, redactions_total bigint"
        held = contexts.agg(F.countDistinct("context")).scalar() if contexts is not None else F.lit(0)
        total = self.totals()
        return spark.createDataFrame([tuple(total.values())], schema).withColumns({"contexts": held.cast("bigint"), "healthy": F.lit(1)})


class StreamMetrics(StreamingQueryListener):
    """The same of streams that watch_stream() marked: spark.streams.addListener(listener), and ``totals`` grows by batch."""

    NAME = "redaction"

    def __init__(self) -> None:
        self.totals = {"documents": 0, "tokens_received": 0, "redactions_total": 0}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.NAME)
        # A trigger without new rows has nothing to tell.
        if seen is not None and event.progress.numInputRows:
            for name in self.totals:
                self.totals[name] += getattr(seen, name)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watch_stream(redacted: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    return redacted.observe(StreamMetrics.NAME, *[c.alias(name) for name, c in counters(text, spans).items()])


def redactions_by_type(explained: DataFrame, spans: str = "spans") -> DataFrame:
    rows = explained.select(F.explode_outer(spans).alias("s")).where("s is not null")
    return rows.groupBy(F.col("s.filter_type").alias("filter_type")).agg(F.count(F.lit(1)).alias("redactions"))
