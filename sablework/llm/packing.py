"""Operator 8: packing into windows by Karmarkar-Karp multiway differencing.

A document's ids (end id included) fill windows of their own as long as they
fill them; what is left over is cut into pieces of at most MAX_PIECE ids. Groups
of pieces that fill about GROUP windows are dealt out by the largest differencing
method: partial partitions with the largest spread merge, the fullest window of
the one with the emptiest of the other, which leaves windows of nearly equal
length. If the fullest exceeds the capacity, there is one window more. The end
of a task's documents, too little for a group, fills windows too; its rest is
cut at powers of two, which need no padding.

All of this happens inside the task that reads the documents: nothing is
shuffled, and a task that is run again gives the same windows. sequence_id
holds the task's number in its upper bits.

Null text counts as empty: one piece, the end id. Repeated rows, and rows of
equal or null ids, are packed as often as they are there. Very long texts are encoded one at a
time and fill windows of their own. Columns other than doc_id and text aren't
looked at, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from bisect import insort
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, located, long_id, small_batches

WINDOW, END_ID, VOCABULARY = 1024, 0, "byte_bpe_50k"
MAX_PIECE, GROUP = 512, 256
#: Share of a group's windows that its pieces fill; the rest is room for uneven windows.
FILL = 0.996
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Encoder:
    """Ids of a text under a byte-level BPE vocabulary.

    The vocabulary's file of ranks gives the same ids as its tokenizer file, four times as fast; only texts that spell
    a special token need the latter, which reads them as such.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of the items in each of k sets with nearly equal sums (largest differencing method, k ways)."""
    # A set is (sum, tree of items); a partial partition lists its non-empty sets by rising sum.
    heap = [(-x, i, [(x, (i,))]) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    by_sum = itemgetter(0)
    stamp = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        # The fullest sets of b meet the emptiest of a: first a's empty ones, then its smallest.
        met, empty = [], k - len(a)
        for total, tree in reversed(b):
            if empty:
                empty -= 1
            else:
                least, other = a.pop(0)
                total, tree = total + least, (other, tree)
            met.append((total, tree))
        if len(met) == 1:
            insort(a, met[0], key=by_sum)
        else:
            a = sorted(a + met, key=by_sum)
        spread = a[-1][0] - (a[0][0] if len(a) == k else 0)
        heapq.heappush(heap, (-spread, stamp, a))
        stamp += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        stack, items = [tree], []
        while stack:
            x = stack.pop()
            items.append(x[0]) if len(x) == 1 else stack.extend(x)
        out.append(sorted(items))
    return out


def windows(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Differencing into as few windows as hold the items; one more whenever the fullest exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = differencing(sizes, k)
        if max((sum(sizes[i] for i in s) for s in sets), default=0) <= capacity:
            return sets
        k += 1


class Packer:
    """Packs the documents of one task; every call returns rows of COLUMNS that are complete."""

    def __init__(self, first_sequence: int, group: int = GROUP, max_piece: int = MAX_PIECE) -> None:
        self.sequence, self.max_piece = first_sequence, max_piece
        self.goal = int(group * WINDOW * FILL)
        self.pool: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.held = 0

    def lay(self, pieces: list[tuple]) -> Iterator[tuple]:
        """One sequence of the pieces, in the order of documents as they came."""
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset
            offset += len(ids)
        self.sequence += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        total = len(ids)
        whole = total - total % WINDOW
        for at in range(0, whole, WINDOW):
            yield from self.lay([(doc_id, at, ids[at : at + WINDOW], total)])
        for at in range(whole, total, self.max_piece):
            piece = (doc_id, at, ids[at : at + self.max_piece], total)
            self.pool.append(piece)
            self.held += len(piece[2])
            if self.held >= self.goal:
                yield from self.deal(self.held - self.goal)

    def cut_last(self, over: int) -> list[tuple]:
        """Takes the last ``over`` ids out of the pool, cutting one piece if need be."""
        out = []
        while over > 0:
            doc_id, start, ids, total = self.pool.pop()
            n = min(over, len(ids))
            if n < len(ids):
                self.pool.append((doc_id, start, ids[:-n], total))
            out.append((doc_id, start + len(ids) - n, ids[-n:], total))
            over -= n
        return out[::-1]

    def deal(self, over: int) -> Iterator[tuple]:
        """Packs the pool but for its last ``over`` ids, which stay."""
        rest = self.cut_last(over)
        for items in windows([len(p[2]) for p in self.pool]):
            yield from self.lay([self.pool[i] for i in items])
        self.pool, self.held = rest, over

    def finish(self) -> Iterator[tuple]:
        """Packs what is left: full windows' worth by differencing, the rest at powers of two."""
        k = int(self.held / (WINDOW * FILL))
        rest = self.held - int(k * WINDOW * FILL)
        if k:
            # Few windows need small pieces to come out even.
            size = max(16, min(self.max_piece, 4 * k))
            self.pool = [(d, s + i, ids[i : i + size], t) for d, s, ids, t in self.pool for i in range(0, len(ids), size)]
            yield from self.deal(rest)
        for power in reversed(range(WINDOW.bit_length())):
            while self.held >= 1 << power:
                tail = self.cut_last(self.held - (1 << power))
                yield from self.lay(self.pool)
                self.pool, self.held = tail, self.held - (1 << power)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, group: int = GROUP, max_piece: int = MAX_PIECE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    kinds = pa.schema([(c, pa.int64()) for c in COLUMNS])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        packer = Packer(TaskContext.get().partitionId() << 40, group, max_piece)
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=kinds)
        for b in batches:
            encode = encode or Encoder(vocabulary)
            rows: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = encode(text.as_py() or "")
                rows += packer.add(doc_id, np.append(ids, np.uint32(END_ID)).astype("<u4"))
                if len(rows) >= 50_000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)
        if rows := list(packer.finish()):
            yield table(rows)

    return docs.select(long_id(docs), "text").mapInArrow(of_batches, ", ".join(f"{c} bigint" for c in COLUMNS))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last one: the pieces of all documents that are left, in the order in which the stage before wrote them.

    Files and rows of the table say what that order is: each task packs a range of it, and later ranges have larger
    sequence numbers, so the mixture of the sources is that of the packed sequences (within a task, but for the pieces of one
    group of windows). Null text counts as empty; null and repeated ids are documents like others; very long texts fill windows of their own;
    other columns aren't looked at, whatever their names; an empty table gives an empty result.
    """
    rows = located(docs, __file="_metadata.file_path", __row="_metadata.row_index").select("doc_id", "text", "__file", "__row")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pack(rows.repartitionByRange(tasks, "__file", "__row").sortWithinPartitions("__file", "__row"))
