"""Exact search for repeated windows of W tokens over a whole corpus, without pairing documents.

Every window has an anchor: of its k-grams the one with the smallest hash
(leftmost on ties). Equal windows have equal anchors, so consecutive windows
with one anchor form a segment, and segments need to meet only those with the
same anchor hash. Narrow rows (hashes) decide which anchors occur again; for
those, texts are cut once per distinct content of a segment. Contents go, by
anchor, with the number of their copies, to an index that finds the windows they
share: hashes route, and what is removed is what the index has found.

An anchor with more than HOT contents (the edge of a passage that is everywhere)
is split further: its windows become contents of their own, routed by 128-bit
digests, and the same index decides on them, so no task gets all of them.

Documents go by their id. Where ids are null or repeated, rows are numbered in
the order of ids (null last), files and rows, and go by that number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, located, long_id, small_batches, text_or_empty, written
from .rolling import U64, prefix, runs, slices, sliding_argmin

HOT = 5000
#: Bytes of texts that are looked at side by side.
SLICE = 1 << 19
#: Tokens of one text that are looked at in one go; longer texts are read in pieces that overlap by W - 1.
PIECE = 2_000_000


@dataclass(frozen=True)
class Search:
    """What to look for: windows of ``width`` tokens, anchors of ``gram`` tokens.

    ``tokens``: texts -> (hashes of all tokens, token counts of the texts, their bytes, where the tokens start and end there).
    ``cut``: text, token spans -> the contents as bytes.
    ``shared``: the index, (contents, windows of each, document and start of each, whether it has copies) -> for each
    content which of its windows go, and which go from its copies.
    ``keep_first``: whether the first occurrence of a window stays.
    ``index_tokens``: tokens of contents that one index holds (the contents of one anchor always share one).
    """

    width: int
    gram: int
    tokens: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]]
    cut: Callable[[bytes, list[tuple[int, int]]], list[bytes]]
    shared: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], tuple[list[np.ndarray], list[np.ndarray]]]
    keep_first: bool
    index_tokens: int


def segments(values: np.ndarray, counts: np.ndarray, raw: bytes, begin: np.ndarray, end: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Segments of texts whose tokens stand one after the other: text, start (token), n (windows), key, content (hash of
    its bytes)."""
    whole = memoryview(raw)
    digest = xxhash.xxh3_64_intdigest
    parts = []
    ends = np.cumsum(counts)
    # Pieces start at PIECE tokens each, with the tokens that the last windows still need.
    for lo in range(0, max(1, len(values)), PIECE):
        v = values[lo : lo + PIECE + width - 1]
        m = len(v) - width + 1
        if m <= 0:
            continue
        p = prefix(v)
        at = np.arange(len(v) - gram + 1)
        grams = runs(p, at, at + gram)
        best = sliding_argmin(grams, width - gram + 1)
        text = np.searchsorted(ends, np.arange(lo, lo + len(v)), side="right")
        valid = text[:m] == text[width - 1 :]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (best[1:] != best[:-1]) | (text[1:m] != text[: m - 1])
        start = np.flatnonzero(new)
        if not len(start):
            continue
        n = np.bincount((np.cumsum(new) - 1)[valid], minlength=len(start))
        owner = text[start]
        first, last = begin[start + lo].tolist(), end[start + lo + n + width - 2].tolist()
        content = np.fromiter((digest(whole[a:b]) for a, b in zip(first, last, strict=True)), U64, len(first))
        parts.append((owner, start + lo - (ends - counts)[owner], n, grams[best[start]], content))
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U64)] * 2
    return {"text": cols[0], "start": cols[1], "n": cols[2], "key": cols[3].view(np.int64), "content": cols[4].view(np.int64)}


def all_segments(docs: DataFrame, s: Search) -> DataFrame:
    schema = "doc_id bigint, start bigint, n int, key bigint, content bigint"

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            texts = [t.encode() for t in b.column("text").to_pylist()]
            for lo, hi in slices(texts, SLICE):
                x = segments(*s.tokens(texts[lo:hi]), s.width, s.gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][x["text"]]), pa.array(x["start"], pa.int64()), pa.array(x["n"], pa.int32()), pa.array(x["key"]), pa.array(x["content"])],
                    names=["doc_id", "start", "n", "key", "content"],
                )

    return docs.mapInArrow(of_batches, schema)


def contents_of(docs: DataFrame, wanted: DataFrame, s: Search) -> DataFrame:
    """key, content, doc_id, start, n, copies, hot, body for the wanted rows, cut from the texts."""
    per_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "key", "content", "copies", "hot")).alias("parts"))
    schema = "key bigint, content bigint, doc_id bigint, start bigint, n int, copies boolean, hot boolean, body binary"
    kinds = [("key", pa.int64()), ("content", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("copies", pa.bool_()), ("hot", pa.bool_())]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text, parts in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("parts"), strict=True):
                parts = parts.as_py()
                bodies = s.cut(text.as_py().encode(), [(p["start"], p["start"] + p["n"] + s.width - 1) for p in parts])
                cols = {c: pa.array([p[c] for p in parts], t) for c, t in kinds} | {"doc_id": pa.array([doc_id] * len(parts), pa.int64()), "body": pa.array(bodies, pa.binary())}
                names = ["key", "content", "doc_id", "start", "n", "copies", "hot", "body"]
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return docs.join(per_doc, "doc_id").select("doc_id", "text", "parts").mapInArrow(of_batches, schema)


def spans_of(gone: np.ndarray) -> list[int]:
    """Runs of True as start, end, start, end, ..."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return edge.tolist()


def by_index(cut: DataFrame, s: Search) -> DataFrame:
    """key, content, gone, again (spans of windows that go from the first place of a content, and from its copies) from
    indexes over the contents of whole keys."""
    rows = cut.repartition("key").sortWithinPartitions("key", "doc_id", "start")
    schema = "key bigint, content bigint, gone array<int>, again array<int>"

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def result() -> pa.RecordBatch:
            where = np.array([(h["doc_id"], h["start"]) for h in held], np.int64).reshape(-1, 2)
            found = s.shared([h["body"] for h in held], np.array([h["n"] for h in held]), where, np.array([h["copies"] for h in held], bool))
            spans = [pa.array([spans_of(g) for g in flags], pa.list_(pa.int32())) for flags in found]
            return pa.RecordBatch.from_arrays(
                [pa.array([h["key"] for h in held], pa.int64()), pa.array([h["content"] for h in held], pa.int64()), *spans], names=["key", "content", "gone", "again"]
            )

        for b in batches:
            for row in b.to_pylist():
                if size >= s.index_tokens and row["key"] != held[-1]["key"]:
                    yield result()
                    held, size = [], 0
                held.append(row)
                size += row["n"] + s.width
        if held:
            yield result()

    return rows.mapInArrow(of_batches, schema)


def by_window(cut: DataFrame, s: Search) -> DataFrame:
    """The same for keys with very many contents: every window is a content of its own.

    128-bit digests of windows rule out those that occur once. Of each other window the first and the last place are cut
    out and meet in an index, dealt out by digest, which decides; so no task gets all windows of a key.
    """
    schema = "key bigint, content bigint, doc_id bigint, start bigint, i int, copies boolean, route bigint, digest bigint"

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = row["n"]
                windows = s.cut(row["body"], [(i, i + s.width) for i in range(n)])
                halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in windows), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array([row[c]] * n, pa.int64()) for c in ("key", "content", "doc_id")], pa.array(range(row["start"], row["start"] + n), pa.int64()),
                        pa.array(range(n), pa.int32()), pa.array([row["copies"]] * n, pa.bool_()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()),
                    ],
                    names=["key", "content", "doc_id", "start", "i", "copies", "route", "digest"],
                )

    rows = written(cut.mapInArrow(digests, schema), "windows")
    place = F.struct("doc_id", "start", "key", "content", "i")
    met = rows.groupBy("route", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("times"), F.max("copies").alias("copies"))
    met = written(met.where("times > 1 or copies").drop("times"), "windows_met")

    ends = met.select("route", "digest", "copies", F.explode(F.array_distinct(F.array("first", "last"))).alias("at"))
    # At most as many windows as one segment has.
    wanted = ends.groupBy("at.key", "at.content").agg(F.collect_list(F.struct("route", "digest", "copies", "at.doc_id", "at.start", "at.i")).alias("parts"))
    kinds = [("route", pa.int64()), ("digest", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64())]
    names = ["key", "content", "doc_id", "start", "n", "copies", "body"]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body, parts in zip(b.column("body"), b.column("parts").to_pylist(), strict=True):
                bodies = s.cut(body.as_py(), [(p["i"], p["i"] + s.width) for p in parts])
                cols = [pa.array([p[c] for p in parts], t) for c, t in kinds]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([1] * len(parts), pa.int32()), pa.array([p["copies"] for p in parts], pa.bool_()), pa.array(bodies, pa.binary())], names=names)

    alone = cut.select("key", "content", "body").join(wanted, ["key", "content"]).select("body", "parts")
    alone = alone.mapInArrow(windows, "key bigint, content bigint, doc_id bigint, start bigint, n int, copies boolean, body binary")
    found = by_index(alone, s).where("size(again) > 0").select(F.col("key").alias("route"), F.col("content").alias("digest"))
    firsts = met.select("route", "digest", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"))
    sure = written(firsts.join(found, ["route", "digest"], "left_semi"), "windows_found")

    back = rows.join(sure, ["route", "digest"])
    goes = (F.col("doc_id") != F.col("first_doc")) | (F.col("start") != F.col("first_start")) if s.keep_first else F.lit(True)
    spans = lambda some: F.flatten(F.transform(F.array_sort(F.collect_set(F.when(some, F.col("i")))), lambda i: F.array(i, i + 1)))
    return back.groupBy("key", "content").agg(spans(goes).alias("gone"), spans(F.lit(True)).alias("again"))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id (unique, in the order of documents), id (as given), text (null: empty)."""
    base = docs.select(long_id(docs), text_or_empty().alias("text"))
    if base.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return base.withColumn("id", F.col("doc_id"))
    rows = located(docs, **ROW).select(long_id(docs), *ROW, text_or_empty().alias("text")).orderBy(F.col("doc_id").asc_nulls_last(), *ROW)
    return written(rows.select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").alias("id"), "text"), "placed")


def covered(docs: DataFrame, s: Search, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(base, spans): base is placed(docs); spans has doc_id and ``spans``, the token ranges covered by windows that
    go, for the documents that have any."""
    small_batches(docs.sparkSession)
    base = placed(docs)
    # Narrow rows, written once: they are read for the counts and for the join.
    every = written(all_segments(base, s), "all_segments")
    # Both sides of this join, and of the one below, are plain tables: then Spark may split the tasks of a hot key.
    again = written(every.groupBy("key").count().where("count > 1").select("key"), "repeated")
    segs = written(every.join(again, "key", "left_semi"), "segments")

    kinds = segs.groupBy("key", "content").agg(
        F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("times"), F.max("n").alias("n")
    )
    kinds = written(kinds.select("key", "content", "first.doc_id", "first.start", "n", (F.col("times") > 1).alias("copies")), "contents")
    hot_keys = kinds.groupBy("key").count().where(F.col("count") > hot).select("key")
    if hot_keys.isEmpty():
        found = by_index(contents_of(base, kinds.withColumn("hot", F.lit(False)), s).drop("hot"), s)
    else:
        # Narrow rows are marked, so that texts needn't be joined to the hot keys.
        marks = written(hot_keys.withColumn("hot", F.lit(True)), "hot_keys")
        marked = kinds.join(marks, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        cut = written(contents_of(base, marked, s), "bodies")
        found = by_index(cut.where("not hot").drop("hot"), s).unionByName(by_window(cut.where("hot").drop("hot"), s))

    fate = kinds.select("key", "content", F.struct("doc_id", "start").alias("first")).join(found.where("size(gone) + size(again) > 0"), ["key", "content"])
    fate = written(fate, "fate")
    rows = segs.join(fate, ["key", "content"])
    gone = F.when(F.struct("doc_id", "start") == F.col("first"), F.col("gone")).otherwise(F.col("again"))
    pairs = rows.select("doc_id", "start", gone.alias("gone")).where(F.size("gone") > 0)
    ranges = F.transform(
        F.sequence(F.lit(0), F.size("gone") - 2, F.lit(2)),
        lambda i: F.struct((F.col("start") + F.col("gone")[i]).alias("lo"), (F.col("start") + F.col("gone")[i + 1] + s.width - 1).alias("hi")),
    )
    spans = pairs.select("doc_id", ranges.alias("r")).groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("r"))).alias("spans"))
    return base, spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of sorted ranges."""
    out: list[tuple[int, int]] = []
    for r in spans or []:
        if out and r["lo"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r["hi"]))
        else:
            out.append((r["lo"], r["hi"]))
    return out
