"""Operator 5: substring deduplication by compressed FM-indexes over shards.

Words that a window of WIDTH words covers go if the window's words also start
earlier. Shards are made by anchor (see anchors.py): the windows that may be
equal are in one shard, whose distinct contents form an FM-index: a wavelet matrix
over the runs of their Burrows-Wheeler transform. The contents stream through it in parallel lanes: backward search
extends every window to the left word by word, and a lane ends as soon as what
it has matched occurs only once, so the number of words matched is the matching
statistic, cut off at WIDTH. Lanes that reach WIDTH have the same interval if and
only if their windows are equal; the earliest of them stays.

Null text has no words; texts of fewer words than a window lose nothing; equal
texts, repeated rows of one id included, keep the first one's words; long texts
are read in overlapping pieces; an empty table gives an empty result; other
columns are ignored. Rows of one id are documents of their own, in the order of
files and rows; rows without doc_id come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import HOT, Search, covered, merged
from .common import documents
from .rolling import U64, joined, word_hashes

WIDTH, GRAM = 20, 6


class Bits:
    """rank(i): how many of the first i bits are set, for arrays of i."""

    def __init__(self, bits: np.ndarray) -> None:
        self.packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, bool)]), bitorder="little").view(U64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed))[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        word, low = i >> 6, (i & 63).astype(U64)
        return self.before[word] + np.bitwise_count(self.packed[word] & ((U64(1) << low) - U64(1)))


class WaveletMatrix:
    """rank(c, i): how often c is among the first i symbols, for arrays of c and i."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.rows = []
        s = symbols
        for shift in reversed(range(self.levels)):
            bit = (s >> shift & 1).astype(bool)
            self.rows.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            s = np.concatenate([s[~bit], s[bit]])
        self.first = self.trace(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))

    def trace(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.rows:
            ones = bits.rank(i)
            i = np.where(c >> shift & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.trace(c, i) - self.first[c]


class RunLengths:
    """The same over runs of equal symbols: a wavelet matrix holds one symbol a run, bits mark where runs start, and
    the runs' lengths are summed up symbol by symbol. The contents of an anchor resemble each other, so their
    Burrows-Wheeler transform has far fewer runs than symbols."""

    def __init__(self, symbols: np.ndarray) -> None:
        new = np.ones(len(symbols), bool)
        new[1:] = symbols[1:] != symbols[:-1]
        self.marks, self.starts = Bits(new), np.append(np.flatnonzero(new), len(symbols)).astype(np.int32)
        self.symbols = symbols[new]
        self.matrix = WaveletMatrix(self.symbols)
        lengths = np.diff(self.starts)[np.argsort(self.symbols, kind="stable")]
        self.upto = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.symbols))]).astype(np.int32)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        # The run that the i-th symbol ends or lies in counts in part, those before it as a whole.
        run = np.maximum(self.marks.rank(i) - 1, 0)
        base = self.first[c]
        whole = self.upto[base + self.matrix.rank(c, run)] - self.upto[base]
        return whole + np.where(self.symbols[run] == c, i - self.starts[run], 0)


class FMIndex:
    """Backward search over a text of symbols, for patterns of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.text, n = text, len(text)
        # Suffixes ordered by their first ``depth`` symbols, which is all that such patterns can tell apart.
        rank, have = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while have < depth:
            later = np.zeros(n, np.int64)
            later[: max(0, n - have)] = rank[have:] + 1
            rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
            have *= 2
        order = np.argsort(rank, kind="stable")
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.bwt = RunLengths(text[order - 1])

    def repeated(self, at: np.ndarray, width: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows text[at : at + width] those that occur ``least`` (1 or 2) times or more: their places in
        ``at``, and a number that stands for the window's content (its interval's start where it occurs again)."""
        lane, alone = np.arange(len(at)), []
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.text), np.int64)
        for step in reversed(range(width)):
            c = self.text[at[lane] + step]
            lo, hi = self.less[c] + self.bwt.rank(c, lo), self.less[c] + self.bwt.rank(c, hi)
            # What occurs once ends here: no longer match of it has company.
            more = hi - lo > 1
            alone.append(lane[~more])
            lane, lo, hi = lane[more], lo[more], hi[more]
        one = np.concatenate(alone)
        one = one[least[one] == 1]
        return np.concatenate([lane, one]), np.concatenate([lo, len(self.text) + one])


def word_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    raw, at = joined(texts)
    starts, ends, h = word_hashes(raw)
    return h, np.bincount(np.searchsorted(at, starts, side="right") - 1, minlength=len(texts)), raw.tobytes(), starts, ends


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[a:b]) for a, b in spans]


def shared_windows(bodies: list[bytes], n: np.ndarray, where: np.ndarray, copies: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each body which of its windows also start earlier in another place of these bodies, and which occur again
    anywhere (a body with copies stands for two places at least)."""
    # Words are numbered by their bytes, in their order of appearance.
    numbers: dict[bytes, int] = {}
    words = [[numbers.setdefault(w, len(numbers) + 1) for w in b.split()] for b in bodies]
    counts = np.array([len(w) for w in words], np.int64)
    symbols = np.fromiter((w for body in words for w in body), np.int64, int(counts.sum()))
    # A separator (0) after each body.
    base = np.cumsum(counts + 1) - counts - 1
    text = np.zeros(len(symbols) + len(bodies), np.int64)
    text[np.arange(len(symbols)) + np.repeat(np.arange(len(bodies)), counts)] = symbols
    body = np.repeat(np.arange(len(bodies)), n)
    i = np.arange(len(body)) - np.repeat(np.cumsum(n) - n, n)
    lane, content = FMIndex(text, WIDTH).repeated(base[body] + i, WIDTH, np.where(copies, 1, 2)[body])
    order = np.lexsort((where[body[lane], 1] + i[lane], where[body[lane], 0], content))
    later = np.zeros(len(order), bool)
    later[1:] = content[order][1:] == content[order][:-1]
    gone, again = np.zeros(len(body), bool), np.zeros(len(body), bool)
    gone[lane[order[later]]] = True
    again[lane] = True
    at = np.cumsum(n)[:-1]
    return np.split(gone, at), np.split(again, at)


SEARCH = Search(WIDTH, GRAM, word_tokens, cut_words, shared_windows, keep_first=True, index_tokens=400_000)


def substring_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space), spans
    (array of lo, hi in words, of what goes)."""
    base, spans = covered(docs, SEARCH, hot)
    rows = base.join(spans, "doc_id", "left").select(F.col("id").alias("doc_id"), "text", "spans")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<lo:bigint,hi:bigint>>"

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for b in batches:
            total, gone, kept, ranges = [], [], [], []
            for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                words = text.as_py().encode().split()
                runs = merged(spans)
                total.append(len(words))
                gone.append(sum(hi - lo for lo, hi in runs))
                ranges.append([{"lo": lo, "hi": hi} for lo, hi in runs])
                for lo, hi in reversed(runs):
                    del words[lo:hi]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(ranges, kind)],
                names=["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    return rows.mapInArrow(of_batches, schema)


def op5_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
