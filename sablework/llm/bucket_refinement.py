"""Operator 6: suffix-array deduplication of bytes by bucket-pointer refinement.

Bytes that a WIDTH-byte string covers go if the string also starts anywhere
else. Strings that may be equal meet by anchor (see anchors.py). There, suffixes
fall into buckets by their first QGRAM bytes; each bucket is then refined by
sorting its suffixes on the bucket of the suffix some bytes later, and the
refined buckets serve the next round, so the depth doubles until it is WIDTH.
Suffixes alone in their bucket drop out. What shares a bucket at depth WIDTH is equal.

Null text counts as empty; texts shorter than WIDTH lose nothing; equal texts
and repeated rows of one id lose all they share; long texts are read in
overlapping pieces; an empty table gives an empty result; other columns are
ignored. Rows of one id, and rows without id, are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import HOT, Search, covered, merged
from .common import documents
from .rolling import BYTE_VALUES

WIDTH, GRAM, QGRAM = 400, 32, 8


def byte_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    raw = b"".join(texts)
    at = np.arange(len(raw) + 1)
    return BYTE_VALUES[np.frombuffer(raw, np.uint8)], np.array([len(t) for t in texts], np.int64), raw, at[:-1], at[1:]


def cut_bytes(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    return [text[a:b] for a, b in spans]


def regrouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the place of its bucket in sorted order, and whether it has company there."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    s = keys[order]
    np.not_equal(s[1:], s[:-1], out=new[1:])
    del s
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(keys)))
    place, shared = np.empty(len(keys), np.int32), np.empty(len(keys), bool)
    place[order] = np.repeat(first, size)
    shared[order] = np.repeat(size > 1, size)
    return place, shared


def equal_suffixes(raw: np.ndarray, left: np.ndarray, width: int, twice: np.ndarray) -> np.ndarray:
    """Which suffixes share their first ``width`` bytes with another; ``left``: bytes from a suffix to its text's end;
    ``twice``: suffixes that stand for two at least, so they share with another even where they are alone in their bucket.

    Numbers of buckets stay below 2^31: there are at most some hundred million suffixes in an index.
    """
    n = len(raw)
    depth = min(QGRAM, width)
    gram = np.zeros(n, np.uint64)
    for i in range(depth):
        gram[: n - i] |= raw[i:].astype(np.uint64) << np.uint64(8 * (QGRAM - 1 - i))
    active = np.flatnonzero(left >= depth)
    # Numbers of different rounds differ, so a suffix that has dropped out never looks like one that goes on.
    bucket = np.arange(n, dtype=np.int32)
    place, shared = regrouped(gram[active])
    del gram
    bucket[active] = n + place
    # A suffix that is alone needs no further round.
    out = twice & (left >= width)
    active = active[shared]
    numbers = 2 * n
    while depth < width and len(active):
        step = min(depth, width - depth)
        active = active[left[active] >= depth + step]
        # A bucket splits by the buckets of the suffixes ``step`` bytes later, as the last round left them.
        place, shared = regrouped(bucket[active].astype(np.int64) * numbers + bucket[active + step])
        bucket[active] = numbers + place
        active = active[shared]
        numbers += n
        depth += step
    out[active] = True
    return out


def shared_strings(bodies: list[bytes], n: np.ndarray, where: np.ndarray, copies: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each body which of its windows (of WIDTH bytes) occur again, in these bodies or in copies; copies lose the same."""
    size = np.array([len(b) for b in bodies], np.int64)
    end = np.cumsum(size)
    left = (np.repeat(end, size) - np.arange(end[-1])).astype(np.int32)
    again = equal_suffixes(np.frombuffer(b"".join(bodies), np.uint8), left, WIDTH, np.repeat(copies, size))
    out = [again[e - z : e - z + k] for e, z, k in zip(end, size, n, strict=True)]
    return out, out


SEARCH = Search(WIDTH, GRAM, byte_tokens, cut_bytes, shared_strings, keep_first=False, index_tokens=600_000)


def suffix_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay), spans (array of lo, hi)."""
    base, spans = covered(docs, SEARCH, hot)
    rows = base.join(spans, "doc_id", "left").select(F.col("id").alias("doc_id"), "text", "spans")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<struct<lo:bigint,hi:bigint>>"

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for b in batches:
            total, gone, kept, ranges = [], [], [], []
            for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                raw = text.as_py().encode()
                runs = merged(spans)
                total.append(len(raw))
                gone.append(sum(hi - lo for lo, hi in runs))
                ranges.append([{"lo": lo, "hi": hi} for lo, hi in runs])
                edges = [0, *[x for r in runs for x in r], len(raw)]
                kept.append(b"".join(raw[lo:hi] for lo, hi in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(r) for r in ranges], pa.int64()),
                    pa.array(kept, pa.binary()), pa.array(ranges, kind),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
            )

    return rows.mapInArrow(of_batches, schema)


def op6_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
