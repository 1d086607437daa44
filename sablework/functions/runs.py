"""Texts cut into runs of characters, a batch at a time: what the dictionaries' Arrow functions work on. Offsets are bytes."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CODE_POINTS = 0x110000


@lru_cache
def ascii_word() -> np.ndarray:
    """Of each code point, whether it is an ASCII letter, digit or underscore."""
    out = np.zeros(CODE_POINTS, bool)
    out[[ord(c) for c in map(chr, range(128)) if c.isalnum() or c == "_"]] = True
    return out


@lru_cache
def letters() -> np.ndarray:
    """Of each code point, whether it is a letter, a decimal digit or an apostrophe."""
    out = np.zeros(CODE_POINTS, bool)
    out[[c for c in range(CODE_POINTS) if (kind := unicodedata.category(chr(c)))[0] == "L" or kind == "Nd"] + [ord("'")]] = True
    return out


@dataclass(frozen=True)
class Runs:
    """All runs of texts in order. ``lo`` and ``hi`` count the bytes of all texts together; text ``i`` begins at ``base[i]``.
    ``sound``: all bytes are UTF-8."""

    base: np.ndarray
    data: bytes
    row: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    member: np.ndarray
    sound: bool

    @property
    def texts(self) -> pa.Array:
        ends = np.concatenate([self.lo, [len(self.data)]]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self.lo), pa.py_buffer(ends), pa.py_buffer(self.data))

    def token(self, lo: int, hi: int) -> str:
        return self.data[lo:hi].decode("utf-8", "replace")

    def tokens(self, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        if not self.sound:
            return pa.array([self.token(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.string())
        ends = np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int64)
        picked = np.frombuffer(self.data, np.uint8)[np.arange(ends[-1]) + np.repeat(lo - ends[:-1], hi - lo)]
        return pa.StringArray.from_buffers(len(lo), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(picked))


def cut(texts: pa.Array, members: np.ndarray) -> Runs:
    """Maximal runs of characters that all are, or all aren't, in ``members`` (a flag per code point). Null texts have none."""
    flat = pc.fill_null(texts, "").cast(pa.large_string())
    whole = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = bytes(memoryview(flat.buffers()[2])[whole[0] : whole[-1]]) if flat.buffers()[2] else b""
    base = whole - whole[0]
    points = np.frombuffer(data.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    # A byte that is no UTF-8 counts as one that stands for itself.
    bad = (points >= 0xDC80) & (points <= 0xDCFF)
    width = np.where(bad, 1, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
    at = np.concatenate([[0], np.cumsum(width)])
    kind = members[points]
    first = np.zeros(len(points) + 1, bool)
    first[np.searchsorted(at, base)] = True
    first = first[:-1]
    first[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(first)
    lo = at[starts]
    hi = np.concatenate([lo[1:], at[-1:]]) if len(lo) else lo
    return Runs(base, data, np.searchsorted(base, lo, side="right") - 1, lo, hi, kind[starts], not bad.any())
