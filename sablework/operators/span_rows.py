"""Span algebra on rows instead of arrays: for documents with more spans than fit a row.

Spans are put in the order of their starts and dealt in ranges, so that a document of any size is spread over tasks. A range is swept by
itself; what it needs to know of the ranges before it is, of its first document, the spans that no other beats (none reaches
further and comes first): the frontier, mostly a few rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sablework.sources.stores import scratch_dir


class Frontier:
    """Spans seen so far that no other beats: by rising ends, which are by rising ranks, too."""

    def __init__(self) -> None:
        self.ends: list[int] = []
        self.ranks: list = []

    def holds(self, end: int, rank) -> bool:
        """A span that came before reaches as far and has a smaller rank; else this one is taken in."""
        at = bisect_left(self.ends, end)
        if at < len(self.ends) and self.ranks[at] < rank:
            return True
        low = at
        while low and self.ranks[low - 1] >= rank:
            low -= 1
        high = at + (at < len(self.ends) and self.ends[at] == end)
        self.ends[low:high], self.ranks[low:high] = [end], [rank]
        return False


def drop_contained_rows(spans: DataFrame, document: str = "doc_id", rank: str = "n", start: str = "start", end: str = "end") -> DataFrame:
    """The rows of ``spans`` that no row of the same document with a smaller rank contains (an equal span contains, too).

    ``rank`` is unique in a document, ``document`` any type that can be compared; rows with a null in one of the four columns are
    left out. Work grows with the rows times the logarithm of the frontier.
    """
    four = [document, rank, start, end]
    whole = spans.dropna(subset=four)
    order = [F.col(document), F.col(start), F.desc(end), F.col(rank)]
    spark, path = spans.sparkSession, f"{scratch_dir(spans.sparkSession)}/dealt"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema(whole.withColumn("__part", F.lit(0)).schema).parquet(path)
    of_part = dealt.select("__part", *four)
    kinds = dict(of_part.dtypes)

    def sweep(batches: Iterator[pa.RecordBatch], seen: dict) -> Iterator[tuple[pa.RecordBatch, list[bool]]]:
        """Batches of one range in order, with what is held; ``seen`` has the document at hand and its frontier."""
        for b in batches:
            held = []
            for d, r, e in zip(*(b.column(c).to_pylist() for c in (document, rank, end)), strict=True):
                if d != seen["document"]:
                    seen["document"], seen["frontier"] = d, Frontier()
                held.append(seen["frontier"].holds(e, r))
            yield b, held

    def last_frontier(table: pa.Table) -> pa.Table:
        ordered = table.sort_by([(document, "ascending"), (start, "ascending"), (end, "descending"), (rank, "ascending")])
        seen = {"document": None, "frontier": Frontier()}
        for _ in sweep(ordered.to_batches(), seen):
            pass
        n = len(seen["frontier"].ends)
        rows = [[table.column("__part")[0].as_py()] * n, [seen["document"]] * n, seen["frontier"].ends, seen["frontier"].ranks]
        return pa.Table.from_arrays([pa.array(r, f.type) for r, f in zip(rows, left, strict=True)], schema=left)

    types = {f.name: f.type for f in to_arrow_schema(of_part.schema)}
    left = pa.schema([("__part", pa.int32()), ("d", types[document]), ("e", types[end]), ("r", types[rank])])
    frontiers = of_part.groupBy("__part").applyInArrow(last_frontier, f"__part int, d {kinds[document]}, e {kinds[end]}, r {kinds[rank]}")
    # The first document of a range may have begun in ranges before it.
    firsts = of_part.groupBy("__part").agg(F.min(document).alias("d")).withColumnRenamed("__part", "to")
    handed = frontiers.join(firsts, (F.col("to") > F.col("__part")) & firsts["d"].eqNullSafe(frontiers["d"])).select(F.col("to").alias("__part"), firsts["d"], "e", "r")

    def kept(table: pa.Table, before: pa.Table) -> pa.Table:
        ordered = table.sort_by([(document, "ascending"), (start, "ascending"), (end, "descending"), (rank, "ascending")])
        seen = {"document": before.column("d")[0].as_py() if before.num_rows else None, "frontier": Frontier()}
        for e, r in sorted(zip(before.column("e").to_pylist(), before.column("r").to_pylist(), strict=True), key=lambda x: x[1]):
            seen["frontier"].holds(e, r)
        held = [h for _, some in sweep(ordered.to_batches(), seen) for h in some]
        return ordered.filter(pa.array([not h for h in held], pa.bool_())).select(dealt_columns)

    dealt_columns = [c for c in dealt.columns if c != "__part"]
    return dealt.groupBy("__part").cogroup(handed.groupBy("__part")).applyInArrow(kept, whole.schema)
